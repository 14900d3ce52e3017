"""Rows and contents of files: numbers of lines over splits, and ids by a hash of what a file holds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.state import StateTable


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of each line of the text files under path, blank ones too, and the folder's partition columns.

    A task numbers the lines of its split of a file while it reads them; a first pass, which sends one row for each split, counts those
    of the splits before. No line is sorted or sent anywhere.
    """
    text = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))

    def number(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        here, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            split = list(zip(b.column("file").to_pylist(), b.column("_block").to_pylist()))
            at = np.empty(len(split), np.int64)
            for i, s in enumerate(split):
                here, n = s, n + 1 if s == here else 1
                at[i] = n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "_at"])

    lines = text.mapInArrow(number, T.StructType([*text.schema.fields, T.StructField("_at", T.LongType())]))
    splits = text.groupBy(F.col("file").alias("_file"), F.col("_block").alias("_start")).agg(F.count("*").alias("_n"))
    before = splits.select("_file", "_start", (F.sum("_n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("_n")).alias("_before"))
    both = lines.join(before, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_start")))
    return both.withColumn("line", F.col("_at") + F.col("_before")).drop("_block", "_at", "_file", "_start", "_before")


def read_numbered_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The contract's columns of CSV files as text, with file and source_row: the header is row 1, and blank lines are rows too.

    The header of one file holds for all; columns that it lacks are null. Quoted line breaks aren't supported: a line is a row.
    """
    head = [c.strip() for c in spark.read.option("header", True).option("escape", "\"").csv(path).columns]
    lines = numbered_lines(spark, path).filter("line > 1")
    parts = [c for c in lines.columns if c not in ("value", "file", "line")]
    own = [c for c in head if c not in parts]
    schema = ", ".join(f"`_{i}` string" for i in range(len(own)))
    cell = F.from_csv("value", F.lit(schema), {"escape": '"'}) if own else F.lit(None)
    lines = lines.withColumn("_row", F.when(F.trim("value") != "", cell))
    return lines.select(*((F.col(f"_row._{own.index(c)}") if c in own else F.lit(None).cast("string")).alias(c) for c in columns), *parts, "file", F.col("line").alias("source_row"))


def file_ids(spark: SparkSession, path: str, *, chunk: int = 4 << 20) -> DataFrame:
    """path, bytes and content_id of each file under path: the first 16 hex digits of its SHA-256, read a chunk at a time. Empty files aren't listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))

    def hashed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            ids = []
            for p in b.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(p)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as source:
                    while data := source.read(chunk):
                        digest.update(data)
                ids.append(digest.hexdigest()[:16])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.string())], names=["path", "bytes", "content_id"])

    return found.repartition("path").mapInArrow(hashed, "path string, bytes long, content_id string")


def registry(path: str) -> StateTable:
    """The contents that are known, each with the first file and the run that brought it."""
    return StateTable(path, "content_id string, path string, bytes long, run string", ("content_id",))


def claim_files(known: StateTable, files: DataFrame, run: str | None = None) -> DataFrame:
    """Registers contents that aren't there yet and returns the files that this run brought, one for each content.

    Of equal contents the least path counts. Of two runs at once that bring the same content one wins, as the registry's versions do.
    """
    run = run or uuid.uuid4().hex
    first = files.groupBy("content_id").agg(F.min(F.struct("path", "bytes")).alias("f")).select("content_id", "f.path", "f.bytes", F.lit(run).alias("run"))
    known.upsert(first, ignore=True)
    return known.read(files.sparkSession).filter(F.col("run") == run).select("content_id", "path", "bytes")
