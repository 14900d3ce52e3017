"""WARC archives and their capture index: format, revisits, searches and edge cases."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import new_folder

PAGE = "page_id long, url string, html string"
ROWS = [
    (1, "http://www.Example.org:80/a?x=1#top", "<p>one</p>"),
    (2, "https://user@example.org/a?x=1", "<p>one</p>"),
    (3, "http://example.org/b c\r\nX: y", "<p>déjà</p>\r\n\r\nmore"),
    (4, None, "<p>one</p>"),
    (5, "", ""),
    (6, "no host here", None),
    (None, "http://example.org/n", "<p>one</p>"),
    (None, "http://example.org/n", "only null ids"),
    (None, "http://example.org/m", "only null ids"),
    (8, "http://example.org/r", "repeated"),
    (8, "http://example.org/r", "repeated"),
    (7, "http://example.org/r", "repeated"),
    (9, "http://example.org", "x" * 300_000),
    (10, "http://münchen.example/ü", "x" * 300_000),
]


def told(rows, least=0):
    """What a record of each row has to say."""
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        best = max(ids, default=None)
        again = len(data) >= least and i != best
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


def seen(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    clash = ["key", "digest", "file", "offset", "shared", "to_id", "n", "again", "target"]
    return spark.createDataFrame(ROWS, PAGE).withColumns({c: F.lit("clash") for c in clash})


@pytest.mark.parametrize(("least", "block", "size"), [(0, 2, 200), (9, 3000, 1 << 30)])
def test_every_page_is_found_by_the_index(spark, pages, least, block, size):
    folder = new_folder(spark, "warc")
    captures = warc.write_archives(pages, folder, least_bytes=least, archive_bytes=size)
    archives = warc.write_index(captures, folder, block_lines=block)
    got = warc.read_pages(spark, archives, pages.select("url", "page_id"))
    assert seen(got) == told(ROWS, least)
    whole = warc.with_payloads(spark, archives, got)
    assert sorted(((r["page_id"], bytes(r["payload"]).decode()) for r in whole.collect()), key=str) == sorted(((i, h or "") for i, _, h in ROWS), key=str)


def test_archives_are_warc_files(spark, pages):
    folder = new_folder(spark, "warc")
    captures = warc.write_archives(pages, folder, archive_bytes=2000)
    files = {r["file"] for r in captures.collect()}
    ids, types = [], []
    for f in files:
        data = gzip.decompress((Path(folder.removeprefix("file://")) / "archives" / f).read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            assert lines[0] == "WARC/1.1" and rest[:size].startswith(b"HTTP/1.1 200 OK\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            ids.append(fields["WARC-Record-ID"])
            types.append(fields["WARC-Type"])
            if types[-1] == "revisit":
                assert rest[:size].endswith(b"\r\n\r\n") and "WARC-Refers-To" in fields
            data = rest[size + 4 :]
    assert len(ids) == len(ROWS) and len(set(ids)) == len(ROWS) - 1  # one whole row is there twice
    assert sorted(types) == sorted(t[3] for t in told(ROWS))


def test_keys_of_urls(spark):
    urls = ["http://www.Example.org:80/a?x=1#top", "//b.example.org", "https://u@h.example/?q", "no host", None, "", "http://a.b/ \x7f"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.surt(F.col("url"))).collect()]
    assert got == ["org,example)/a?x=1", "org,example,b)/", "example,h)/?q", ")no%20host", ")", ")", "b,a)/%20%7F"]


def test_a_url_with_many_captures_spans_blocks_and_files(spark):
    rows = [(i, "http://hot.example/" if i % 3 else f"http://cold{i}.example/", f"text {i}") for i in range(600)]
    pages = spark.createDataFrame(rows, PAGE)
    folder = new_folder(spark, "warc")
    archives = warc.write_index(warc.write_archives(pages, folder), folder, block_lines=7, file_lines=90)
    assert len(archives.files) > 4
    wanted = spark.createDataFrame([("https://HOT.example#x",), ("http://hot.example/",), ("http://cold3.example/",), ("http://not.there/",)], "url string")
    found = warc.find_captures(spark, archives, wanted)
    assert sorted(r["page_id"] for r in found.collect()) == sorted([i for i in range(600) if i % 3] + [3])
    one = warc.find_captures(spark, archives, spark.createDataFrame([("http://hot.example/", 100), ("http://hot.example/", 3)], "url string, page_id long"))
    assert [r["page_id"] for r in one.collect()] == [100]
    body = warc.read_pages(spark, archives, wanted).filter("page_id = 3").first()
    assert bytes(body["payload"]) == b"text 3" and body["url"] == "http://cold3.example/"


def test_rows_equal_in_all_are_one_capture_each(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "same")] * 50, PAGE)
    folder = new_folder(spark, "warc")
    archives = warc.write_index(warc.write_archives(pages, folder), folder, block_lines=4, file_lines=10)
    got = warc.read_pages(spark, archives, pages.select("url", "page_id"))
    assert seen(got) == told([(1, "", "same")] * 50)


def test_no_pages(spark, pages):
    archives = warc.archive_pages(pages.filter("false"))
    assert archives.files == [] and warc.read_pages(spark, archives, pages.select("url")).count() == 0


def test_a_broken_record_or_directory_is_told(tmp_path):
    member = warc.record((1, "http://a/"), b"payload", warc.base32(hashlib.sha1(b"payload").digest()), None, "2000-01-01T00:00:00Z")
    assert warc.Record.parse(member).payload == b"payload"
    wrong = gzip.compress(zlib.decompress(member, 31).replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(ValueError, match="payload"):
        warc.Record.parse(wrong)
    store, path = warc.open_folder(f"file://{tmp_path}/x")
    entries = [(b"a)/", -5, 0, 10), (b"b)/", 1, 10, 4)]
    (tmp_path / "x").write_bytes(b"0" * 14 + warc.packed_directory(entries))
    assert warc.read_directory(store, path) == entries
