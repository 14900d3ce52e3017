"""Reading raw tables as text, writing results, and ids by content."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir, or a local one where it is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df as a table in the shared folder, so that what reads it twice reads the same rows and partitions."""
    spark, path, schema = df.sparkSession, work_folder(df.sparkSession, kind), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_raw(spark: SparkSession, path: str, columns: Sequence[str], kind: str = "csv") -> DataFrame:
    """All columns of the contract as text, whatever the file holds; columns that it lacks are null, others are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if kind == "csv":
        head = spark.read.option("header", True).csv(path)
        return head.select(*(F.col(f"`{c}`").alias(c) if c in head.columns else F.lit(None).cast("string").alias(c) for c in columns))
    if kind == "json":
        return spark.read.schema(schema).json(path)
    if kind == "parquet":
        have = spark.read.parquet(path)
        return have.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in columns))
    raise ValueError(f"{kind} isn't csv, json or parquet")


def read_imputation_log(spark: SparkSession, path: str, known: Sequence[str], aliases: DataFrame) -> DataFrame:
    """date, field of the cells that a CSV log names: distinct, with aliases (alias, canonical) resolved and unknown fields left out.

    A log that can't be read, or has no columns date and field, names no cell: the result is empty. Rows without a field or with a date
    that can't be read are left out.
    """
    from pyspark.errors import AnalysisException

    from tidemark.operators.contract import distinct_cells, rename_fields, to_day

    try:
        log = spark.read.option("header", True).csv(path)
    except AnalysisException:
        log = None
    head = {c.strip(): c for c in log.columns} if log is not None else {}
    if not {"date", "field"} <= head.keys():
        return spark.createDataFrame([], "date date, field string")
    rows = log.select(F.col(f"`{head['date']}`").alias("date"), F.trim(F.col(f"`{head['field']}`")).alias("field"))
    return distinct_cells(rename_fields(rows, aliases, "field", known).withColumn("date", to_day("date")), ["date", "field"])


def read_clean(spark: SparkSession, path: str, date: str) -> DataFrame:
    """A Parquet table with its date at midnight."""
    return spark.read.parquet(path).withColumn(date, F.to_date(date))


def write_parts(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet by dataset; one shuffle by the same columns keeps the number of files down, and a large part is split."""
    df.hint("rebalance", *by).write.partitionBy(*by).mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def content_ids(rows: DataFrame, content: str) -> DataFrame:
    """content_id: the first 16 hex digits of the content's SHA-256."""
    return rows.withColumn("content_id", F.substring(F.sha2(F.col(content).cast("binary"), 256), 1, 16))


def new_content(rows: DataFrame, registry: DataFrame, order: str) -> DataFrame:
    """Of rows with content_id, the first of each that the registry doesn't have."""
    first = rows.groupBy("content_id").agg(F.min(order).alias(order))
    return first.join(registry.select("content_id").distinct(), "content_id", "left_anti")


def describe(rows: DataFrame, summaries: DataFrame, keys: Sequence[str], date: str, as_of) -> DataFrame:
    """A descriptor of each dataset: dates, rows, quality counts, status, warnings."""
    base = rows.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("latest_date"), F.count("*").alias("row_count"))
    out = base.join(summaries, list(keys), "left")
    warnings = F.array_compact(F.array(F.when(F.col("latest_date") > F.lit(as_of).cast("date"), "FUTURE_DATED"), F.when(F.col("suspect") + F.col("invalid") > 0, "QUALITY_REVIEW")))
    return out.withColumns({"warnings": warnings, "status": F.when(F.col("row_count") >= 20, "READY").otherwise("INSUFFICIENT_HISTORY")})
