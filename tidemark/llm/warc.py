"""WARC archives of pages with revisit records, and a two-level capture index over them.

Archives: a gzip member for each record. A payload that several pages share is stored once, in the response record of the page with the
largest id; the others are revisit records, which keep the payload's digest and length and name that page.

Index: a line for each record, ``reversed host)path id {json}``, sorted over all archives and cut into blocks of some thousand lines, each
compressed alone. An index file ends with its directory, the first key and the place of each block; above it stands a list of the index
files with their first and last keys. A search goes down from that list by bisection: files, directory, block, line; only then is the
range of a record read from its archive. Of the whole index only that list, a row for each index file, ever reaches the driver.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, new_folder, partitions, small_batches
from tidemark.llm.token_files import open_folder

DIRECTORY = struct.Struct("<QI")
#: Above every id, and below: nulls come first.
LEAST, MOST = -(1 << 63) - 1, 1 << 63


def surt(url: Column) -> Column:
    """The url's key: host reversed and lower-cased, without user, port or `www.`, then `)` and the path with its query. Null: `)`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@|:\d*$", ""), r"^www\d*\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([\s\S]*)", 1)
    other = F.when((rest == "") & url.isNotNull(), F.regexp_replace(url, r"#[\s\S]*$", "")).otherwise(F.lit(""))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", other).otherwise(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))
    # A key is one word of one line, and the same for a url as it stands in a record's head.
    return F.when(key.rlike(r"[\x00-\x20\x7F]"), reduce(lambda k, c: F.replace(k, F.lit(chr(c)), F.lit(f"%{c:02X}")), [*range(0x21), 0x7F], key)).otherwise(key)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def one_line(value: str) -> str:
    """Control characters and blanks as the percent escapes that a URL has for them."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest(), version=3)}>"


def record(page, payload: bytes, digest: str, target, date: str) -> bytes:
    """One record as a gzip member. page: (id, url); target: None for a response, else the (id, url) of the page that it revisits."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if target else head + payload
    fields = {
        "WARC-Type": "revisit" if target else "response",
        "WARC-Record-ID": record_id(digest, *page, bool(target)),
        "WARC-Date": date,
        "WARC-Target-URI": None if page[1] is None else one_line(page[1]),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": page[0],
    }
    if target:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(digest, *target, False),
            "WARC-Refers-To-Target-URI": None if target[1] is None else one_line(target[1]),
            "WARC-Refers-To-Date": date,
            "X-Refers-To-Page-Id": target[0],
        }
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


@dataclass
class Record:
    """A record read back: fields of its head, and the payload (None for a revisit)."""

    fields: dict[str, str]
    payload: bytes | None
    payload_bytes: int

    @classmethod
    def parse(cls, member: bytes) -> Record:
        data = zlib.decompress(member, 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
        if fields["WARC-Type"] == "revisit":
            return cls(fields, None, size)
        if len(payload) != size or fields["WARC-Payload-Digest"] != f"sha1:{base32(hashlib.sha1(payload).digest())}":
            raise ValueError("a payload doesn't match its record")
        return cls(fields, payload, size)


def task_file(kind: str, end: str, n: int = 0) -> str:
    """A name that no other attempt of the task has."""
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():05d}-{n:03d}.{task.taskAttemptId()}.{end}"


@dataclass
class Archives:
    """A folder of archives and their index. files: (name, first key, last key) of each index file, in order."""

    folder: str
    files: list[tuple[str, tuple[bytes, int], tuple[bytes, int]]]


CAPTURE = "key string, page_id long, url string, record_type string, digest string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, archive_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the table of captures, itself written under folder.

    Payload: html in UTF-8; null counts as empty. Of the rows with equal payloads of least_bytes or more, that with the largest page_id
    is a response and the others revisit it; null ids are below all others, and rows that share the largest id (or have none but nulls)
    are all responses. Smaller payloads are always responses. A row's html is held whole in its task. Other columns are left aside; an
    empty table gives an empty result. A task writes under names of its own attempt, and only files that the table of captures names
    count, so attempts of lost executors do no harm. Payloads aren't shuffled unless too many of them repeat for a broadcast; a payload
    that many rows share is then split by Spark's skew join.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    large = rows.filter(F.octet_length("html") >= least_bytes).select("digest", "page_id", "url")
    first = large.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("target")).filter("n > 1")
    first = cut(first.select(F.col("digest").alias("shared"), F.col("target.page_id").alias("to_id"), F.col("target.url").alias("to_url")))
    dealt = rows.join(first, (F.col("digest") == F.col("shared")) & (F.octet_length("html") >= least_bytes), "left")
    dealt = dealt.select("page_id", "url", surt(F.col("url")).alias("key"), "html", "digest", "to_id", "to_url", (F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to_id"))).alias("again"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, path = open_folder(f"{folder}/archives")
        store.create_dir(path, recursive=True)
        out, name, at, n = None, None, 0, 0
        for b in batches:
            found = []
            for row in b.to_pylist():
                if out is None:
                    name, at = task_file("pages", "warc.gz", n), 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                digest = base32(row["digest"])
                target = (row["to_id"], row["to_url"]) if row["again"] else None
                member = record((row["page_id"], row["url"]), row["html"].encode("utf-8", "surrogatepass"), digest, target, date)
                out.write(member)
                found.append((row["key"], row["page_id"], row["url"], "revisit" if target else "response", digest, name, at, len(member)))
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    out, n = None, n + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=re.findall(r"(\w+) \w+(?:,|$)", CAPTURE))
        if out is not None:
            out.close()

    dealt.mapInArrow(write, CAPTURE).write.parquet(f"{folder}/captures")
    return spark.read.schema(CAPTURE).parquet(f"{folder}/captures")


def packed_directory(entries: list[tuple[bytes, int, int, int]]) -> bytes:
    """(first key, first id, offset, length) of each block, compressed, and its own length behind it."""
    lines = b"".join(b"%s %d %d %d\n" % e for e in entries)
    packed = zlib.compress(lines)
    return packed + DIRECTORY.pack(len(packed), len(entries))


def write_index(captures: DataFrame, folder: str, *, block_lines: int = 3000, file_lines: int = 1_000_000) -> Archives:
    """Sorts the captures by key and id over all archives and writes them as index files of compressed blocks, each with its directory.

    Files are dealt by ranges of key and id, so that neither a url nor a host is bound to one task; rows equal in both stand in the
    order of their archives' names and offsets, which deals them too.
    """
    spark = captures.sparkSession
    files = max(partitions(spark), -(-captures.count() // file_lines))
    order = ["key", "page_id", "file", "offset"]
    rows = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, path = open_folder(f"{folder}/index")
        store.create_dir(path, recursive=True)
        name, out, at, entries, held, first, last = None, None, 0, [], [], None, None

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress(b"".join(held))
            out.write(data)
            entries.append((*start, at, len(data)))
            at, held = at + len(data), []

        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name = task_file("captures", "cdx.z")
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                key = row.pop("key").encode("utf-8", "surrogatepass")
                last = (key, LEAST if row["page_id"] is None else row["page_id"])
                first = first or last
                if not held:
                    start = last
                held.append(b"%s %d %s\n" % (*last, json.dumps(row).encode()))
                if len(held) == block_lines:
                    flush()
        if out is not None:
            if held:
                flush()
            out.write(packed_directory(entries))
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [first[0]], "first_id": [str(first[1])], "last": [last[0]], "last_id": [str(last[1])]}, schema=pa.schema([("name", pa.string()), ("first", pa.binary()), ("first_id", pa.string()), ("last", pa.binary()), ("last_id", pa.string())]))

    # One row for each index file.
    found = cut(rows.mapInArrow(write, "name string, first binary, first_id string, last binary, last_id string")).collect()
    return Archives(folder, sorted(((r["name"], (bytes(r["first"]), int(r["first_id"])), (bytes(r["last"]), int(r["last_id"]))) for r in found), key=lambda f: f[1:]))


def read_directory(store, path: str) -> list[tuple[bytes, int, int, int]]:
    with store.open_input_file(path) as f:
        end = f.size() - DIRECTORY.size
        f.seek(end)
        size, n = DIRECTORY.unpack(f.read(DIRECTORY.size))
        f.seek(end - size)
        lines = [x.split(b" ") for x in zlib.decompress(f.read(size)).split(b"\n")[:-1]]
    if len(lines) != n:
        raise ValueError("a directory of an index file is broken")
    return [(k, int(i), int(at), int(length)) for k, i, at, length in lines]


def find_captures(spark: SparkSession, archives: Archives, wanted: DataFrame) -> DataFrame:
    """The captures of wanted, a table of urls and, if it has the column page_id, the one capture of each (null: of the null id).

    Each result row is a capture that any wanted row asks for, once, however often it is asked for. Urls that have one key (see surt)
    are one page. A url of any number of captures is searched for in the directories of all files that its key spans, and its blocks are
    then read by as many tasks as there are blocks.
    """
    by_id = "page_id" in wanted.columns
    keys = wanted.select(surt(F.col("url")).alias("key"), *([F.col("page_id").cast("long").alias("page_id")] if by_id else [])).distinct()
    order = keys.columns
    keys = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    folder, files = f"{archives.folder}/index", archives.files
    lasts = [f[2] for f in files]

    def search(batches: Iterator) -> Iterator:
        """Blocks whose range of keys meets that of a wanted row, by bisection in the list of files and in their directories."""
        import pyarrow as pa

        store, path = open_folder(folder)
        name, blocks, firsts = None, [], []
        for b in batches:
            found = []
            names = b.column("key").to_pylist()
            ids = b.column("page_id").to_pylist() if by_id else [None] * len(names)
            for text, i in zip(names, ids):
                key = text.encode("utf-8", "surrogatepass")
                low, high = ((key, LEAST if i is None else i),) * 2 if by_id else ((key, LEAST), (key, MOST))
                for k in range(bisect.bisect_left(lasts, low), len(files)):
                    if files[k][1] > high:
                        break
                    if files[k][0] != name:
                        name = files[k][0]
                        blocks = read_directory(store, f"{path}/{name}")
                        firsts = [x[:2] for x in blocks]
                    # Equal keys may start in the block before the first one that starts with them.
                    for j in range(max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_right(firsts, high)):
                        found.append((name, blocks[j][2], blocks[j][3], key, str(low[1]), str(high[1])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()))], names=["index", "at", "size", "key", "low", "high"])

    places = keys.mapInArrow(search, "index string, at long, size long, key binary, low string, high string")
    places = places.repartition("index", "at").sortWithinPartitions("index", "at")

    def read(batches: Iterator) -> Iterator:
        """Lines of a block that are in a wanted range, by bisection."""
        import pyarrow as pa

        store, path = open_folder(folder)
        here, lines, keys, source, name = None, [], [], None, None
        for b in batches:
            found = []
            for row in b.to_pylist():
                if (row["index"], row["at"]) != here:
                    if row["index"] != name:
                        name, source = row["index"], store.open_input_file(f"{path}/{row['index']}")
                    source.seek(row["at"])
                    here = (row["index"], row["at"])
                    lines = [x.split(b" ", 2) for x in zlib.decompress(source.read(row["size"])).split(b"\n")[:-1]]
                    keys = [(k, int(i)) for k, i, _ in lines]
                low, high = (bytes(row["key"]), int(row["low"])), (bytes(row["key"]), int(row["high"]))
                for j in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)):
                    found.append(json.loads(lines[j][2]) | {"key": lines[j][0].decode("utf-8", "surrogatepass")})
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "record_type", "digest", "file")), ("offset", pa.int64()), ("length", pa.int64())]))

    return places.mapInArrow(read, CAPTURE)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_url string, payload binary"


def read_records(captures: DataFrame, folder: str, *, payloads: bool = True, span: int = 8 << 20) -> DataFrame:
    """The records of captures, read from their archives; payload is null for a revisit, or for all records without payloads.

    Captures that stand close to each other are read as one range of up to ``span`` bytes.
    """
    small_batches(captures.sparkSession, 500)
    rows = captures.select("file", "offset", "length").repartitionByRange(partitions(captures.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, path = open_folder(f"{folder}/archives")
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_url", pa.string()), ("payload", pa.binary())])
        name, source = None, None

        def number(x: str | None) -> int | None:
            return None if x is None else int(x)

        for b in batches:
            places = list(zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()))
            k, found, held = 0, [], 0
            while k < len(places):
                file, start, _ = places[k]
                if file != name:
                    name, source = file, store.open_input_file(f"{path}/{file}")
                near = k
                while near + 1 < len(places) and places[near + 1][0] == file and places[near + 1][1] + places[near + 1][2] - start <= span:
                    near += 1
                source.seek(start)
                data = source.read(places[near][1] + places[near][2] - start)
                for _, at, length in places[k : near + 1]:
                    r = Record.parse(data[at - start : at - start + length])
                    f = r.fields
                    payload = r.payload if payloads else None
                    found.append({"page_id": number(f.get("X-Page-Id")), "url": f.get("WARC-Target-URI"), "payload_bytes": r.payload_bytes, "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": f["WARC-Type"], "refers_to": number(f.get("X-Refers-To-Page-Id")), "refers_to_url": f.get("WARC-Refers-To-Target-URI"), "payload": payload})
                    held += len(payload or b"")
                    if held > span:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found, held = [], 0
                k = near + 1
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> Archives:
    """Archives and index of pages under a new folder of the shared one, or the given one."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return write_index(write_archives(pages, folder, **options), folder)


def read_pages(spark: SparkSession, archives: Archives, wanted: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records of the wanted urls (and page ids), found by the index."""
    return read_records(cut(find_captures(spark, archives, wanted)), archives.folder, payloads=payloads)


def with_payloads(spark: SparkSession, archives: Archives, records: DataFrame) -> DataFrame:
    """records with the payload of the response that each revisit names, which is looked up in the index too."""
    missing = records.filter("record_type = 'revisit'")
    sought = missing.select(F.col("refers_to_url").alias("url"), F.col("refers_to").alias("page_id")).distinct()
    found = read_pages(spark, archives, sought).filter("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload").alias("_found"))
    return records.join(found, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "_found")).select(*records.columns)
