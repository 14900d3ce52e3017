"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(where)
        return where.rstrip("/")
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of one run, under the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as a table, so that its lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the column as text, modulo mod."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_and(df: DataFrame, **more: str) -> T.StructType:
    """df's schema and further columns, by name and type."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items())])


def each_text(batch, column: str, rows: int = 256):
    """The texts of an Arrow batch, a few rows at a time in memory."""
    for at in range(0, batch.num_rows, rows):
        yield from batch.column(column).slice(at, rows).to_pylist()


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Keeps Arrow batches of whole texts small in this session, so that a Python worker holds few of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system, so that idle workers between stages hold little."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one aggregate, by which blocks are sized."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def by_block(df: DataFrame, blocks: int, column: str, make, schema: str) -> DataFrame:
    """make(frame) of each block's rows. column numbers the blocks from 0; a partition holds one of them, so nothing is sorted."""

    def each(batches):
        import pandas as pd

        held = list(batches)
        if held:
            yield make(pd.concat(held, ignore_index=True))
        held = []
        release_memory()

    return df.repartitionById(blocks, F.col(column)).mapInPandas(each, schema)
