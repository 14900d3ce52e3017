"""Line numbers over splits of files, and ids of files."""

import hashlib

import pytest

from tidemark.sources import files as N
from tidemark.sources.store import work_folder


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_rows_of_several_splits_count_from_two(spark, tmp_path, small_splits):
    want = {}
    for name, n in (("x.csv", 200), ("y.csv", 3), ("z.csv", 0)):
        lines = ['id," text ",other', *("" if i % 7 == 3 else f'{i},"a, ""{i}""",' for i in range(n))]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want |= {(name, k): None if not x else (str(k - 2), f'a, "{k - 2}"') for k, x in enumerate(lines, 1) if k > 1}
    got = N.read_numbered_csv(spark, f"file://{tmp_path}", ["id", "text", "absent"])
    assert spark.read.text(f"file://{tmp_path}").select("_metadata.file_block_start").distinct().count() > 5
    rows = got.collect()
    assert {(r["file"].rsplit("/", 1)[1], r["source_row"]): (r["id"], r["text"]) if r["id"] else None for r in rows} == want
    assert len(rows) == len(want) and all(r["absent"] is None for r in rows)


def test_files_are_known_by_what_they_hold(spark, tmp_path):
    texts = {"a": b"one", "b": b"two" * 5000, "c": b"one", "d": b"\x00"}
    (tmp_path / "empty").write_bytes(b"")
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    files = N.file_ids(spark, f"file://{tmp_path}", chunk=1000)
    assert {(r["path"].rsplit("/", 1)[1], r["content_id"], r["bytes"]) for r in files.collect()} == {(k, hashlib.sha256(v).hexdigest()[:16], len(v)) for k, v in texts.items()}
    known = N.registry(work_folder(spark, "registry"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in N.claim_files(known, files).collect()) == ["a", "b", "d"]
    (tmp_path / "e").write_bytes(b"new")
    assert [r["path"].rsplit("/", 1)[1] for r in N.claim_files(known, N.file_ids(spark, f"file://{tmp_path}")).collect()] == ["e"]
    assert known.read(spark).count() == 4
