"""State tables that survive restarts: rows by key, in versions, replaced by whole buckets.

A table is a folder with ``data`` and ``versions``. Rows lie in buckets by a hash of their key; a version is a small JSON file that names
the folder of each bucket. A write merges its rows with those of the buckets that it touches, puts these into a new folder, and only then
publishes a version that names it. Readers use the last version, so a write that fails, or is tried again, changes nothing that they see;
writing the same rows again gives the same table. Of two writers that start from one version, one publishes the next and the other merges
again with what is there then.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class StateTable:
    """A table under path with its schema (DDL), key columns and number of buckets, which stays as it was when the table began."""

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 16

    def folder(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, spark: SparkSession) -> list[int]:
        path, fs = self.folder(spark)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def buckets_of(self, spark: SparkSession, version: int | None = None) -> dict[int, str]:
        """Each filled bucket's folder in a version, or in the last one."""
        known = self.versions(spark)
        if not known:
            return {}
        version = known[-1] if version is None else version
        return {int(k): v for k, v in json.loads(spark.read.text(f"{self.path}/versions/{version:010d}.json", wholetext=True).first()[0]).items()}

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The table as the last version, or an older one, has it."""
        return self._rows(spark, list(self.buckets_of(spark, version).values()))

    def _rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def upsert(self, rows: DataFrame, *, ignore: bool = False, latest: Sequence[str] = (), tries: int = 5) -> int:
        """Puts rows in by key and returns the version that has them; with ignore, rows of keys that are there already are left out.

        Of several rows with one key the last by ``latest``, and then by all columns, stays; with ignore the first. Nulls in keys are
        values like others. Columns that rows lack are null, others are left out. No rows: no new version.
        """
        spark = rows.sparkSession
        fields = T._parse_datatype_string(self.schema).fields
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        plain = [f.name for f in fields if not isinstance(f.dataType, T.MapType)]  # maps have no order
        order = [F.col(c).asc() if ignore else F.col(c).desc() for c in [*latest, *(c for c in plain if c not in latest)]]
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))).filter("_n = 1").drop("_n")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        staged = f"{self.path}/data/rows-{uuid.uuid4().hex}"
        new.withColumn("bucket", bucket).write.parquet(staged)
        new = spark.read.parquet(staged)
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if not touched:
            return max(self.versions(spark), default=0)
        for _ in range(tries):
            before = max(self.versions(spark), default=0)
            have = self.buckets_of(spark)
            old = self._rows(spark, [have[b] for b in touched if b in have]).withColumn("bucket", bucket)
            kept, added = (old, self._without(new, old)) if ignore else (self._without(old, new), new)
            name = f"version-{before + 1}-{uuid.uuid4().hex}"
            columns = [*(f.name for f in fields), "bucket"]
            kept.select(*columns).unionByName(added.select(*columns)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            if self._publish(spark, before + 1, have | {b: f"{name}/bucket={b}" for b in touched}):
                return before + 1
        raise RuntimeError(f"other writers won {tries} times at {self.path}")

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        keys = others.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)))
        match = F.lit(True)
        for i, k in enumerate(self.keys):
            match = match & F.col(k).eqNullSafe(F.col(f"_{i}"))
        return rows.join(keys, match, "left_anti")

    def _publish(self, spark: SparkSession, version: int, buckets: dict[int, str]) -> bool:
        """Renames a finished file into place; false if the version is there already."""
        jvm, (path, fs) = spark._jvm, self.folder(spark)
        fs.mkdirs(path)
        whole = jvm.org.apache.hadoop.fs.Path(path, f"_{uuid.uuid4().hex}")
        out = fs.create(whole, False)
        out.write(bytearray(json.dumps(buckets, sort_keys=True).encode()))
        out.close()
        names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            names.rename(whole, jvm.org.apache.hadoop.fs.Path(path, f"{version:010d}.json"), options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(whole, False)
            return False
        return True


def state_tables(path: str, buckets: int = 16) -> dict[str, StateTable]:
    """The tables that stay between runs, under path."""
    kinds = {
        "datasets": ("dataset_id string, file_name string, first_date date, latest_date date, row_count long, status string, created_at timestamp, warnings array<string>", ("dataset_id",)),
        "dq_summary": ("dataset_id string, valid long, missing long, suspect long, invalid long, counts map<string,long>", ("dataset_id",)),
        "model_runs": ("run_id string, dataset_id string, model_version string, origin_date date, status string, created_at timestamp, audit string", ("run_id",)),
        "predictions": ("run_id string, dataset_id string, target string, horizon int, target_date date, prediction double, status string, reason string", ("run_id", "target", "horizon")),
        "reliability_errors": ("dataset_id string, target string, horizon int, origin_date date, target_date date, expert_id string, y_true double, error double, sq_error double", ("dataset_id", "target", "horizon", "origin_date", "expert_id")),
    }
    return {name: StateTable(f"{path}/{name}", schema, keys, buckets) for name, (schema, keys) in kinds.items()}


def with_run(forecasts: DataFrame) -> DataFrame:
    """Forecasts that have a value, with run_id, the dataset and the origin."""
    return forecasts.filter(F.col("prediction").isNotNull()).withColumn("run_id", F.concat_ws("/", F.col("dataset_id"), F.col("origin_date").cast("string")))


def save_runs(table: StateTable, forecasts: DataFrame, version: str, created_at) -> None:
    """A run row for each dataset and origin, whose audit is a JSON object of all its forecasts, of every target and horizon.

    forecasts: dataset_id, target, origin_date, horizon, target_date, prediction.
    """
    entry = F.struct(F.concat_ws("__h", "target", F.col("horizon").cast("string")), "prediction")
    runs = with_run(forecasts).groupBy("run_id", "dataset_id", "origin_date").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("audit"))
    table.upsert(runs.withColumns({"model_version": F.lit(version), "status": F.lit("AVAILABLE"), "created_at": F.lit(created_at)}), latest=["created_at"])


def save_predictions(table: StateTable, forecasts: DataFrame, gas: str, volume: str) -> None:
    """The gas's predictions, and purity_derived for the day after the origin; the volume's are in the audit alone.

    The purity is that of the first horizon's gas in its volume, and has no row where the two are out of proportion.
    """
    from tidemark.functions.scalars import next_day_purity

    rows = with_run(forecasts)
    first = rows.filter("horizon = 1").groupBy("run_id", "dataset_id", "target_date").agg(*(F.max(F.when(F.col("target") == t, F.col("prediction"))).alias(c) for t, c in ((gas, "_gas"), (volume, "_volume"))))
    purity = first.select("run_id", "dataset_id", F.lit("purity_derived").alias("target"), F.lit(1).cast("long").alias("horizon"), "target_date", next_day_purity("_gas", "_volume")[0].alias("prediction")).filter(F.col("prediction").isNotNull())
    kept = rows.filter(F.col("target") == gas).select("run_id", "dataset_id", "target", F.col("horizon").cast("long").alias("horizon"), "target_date", "prediction")
    table.upsert(kept.unionByName(purity).withColumn("status", F.lit("AVAILABLE")))


def read_predictions(tables: dict[str, StateTable], spark: SparkSession) -> DataFrame:
    """All predictions that are stored: run_id, target, horizon, target_date, prediction; the volume's come from their runs' audits."""
    rows = tables["predictions"].read(spark).select("run_id", "target", F.col("horizon").cast("long").alias("horizon"), "target_date", "prediction")
    entries = tables["model_runs"].read(spark).select("run_id", "origin_date", F.explode(F.from_json("audit", "map<string,double>")).alias("name", "prediction"))
    horizon = F.substring_index("name", "__h", -1).cast("int")
    entries = entries.select("run_id", F.regexp_extract("name", "^(.*)__h", 1).alias("target"), horizon.cast("long").alias("horizon"), F.date_add("origin_date", horizon).alias("target_date"), "prediction")
    return rows.unionByName(entries.join(rows.select("run_id", "target", "horizon"), ["run_id", "target", "horizon"], "left_anti").select(*rows.columns))


def mature_errors(table: StateTable, errors: DataFrame) -> None:
    """Errors whose truth has arrived; one that is stored already stays as it is."""
    table.upsert(errors, ignore=True)
