"""Joins and set operations of the process-health queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_on_date(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with the columns of right on the same keys."""
    return left.join(right.select(*keys, *columns), list(keys), "left")


def misaligned(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Rows whose two representations differ by more than 1e-6 + 1e-5 * |right|."""
    return a.join(b, list(keys)).filter(F.abs(F.col(left) - F.col(right)) > 1e-6 + 1e-5 * F.abs(F.col(right)))


def provenance(rows: DataFrame, cells: DataFrame, keys: Sequence[str], value: str, fields: Sequence[str]) -> DataFrame:
    """source: UNAVAILABLE, DERIVED_FROM_IMPUTED or DERIVED_FROM_OBSERVED, with the imputed ones of the value's fields."""
    imputed = cells.filter(F.col("field").isin(*fields)).groupBy(*keys).agg(F.array_sort(F.collect_set("field")).alias("_imputed"))
    out = rows.join(imputed, list(keys), "left")
    known = F.col(value).isNotNull()
    source = F.when(~known, "UNAVAILABLE").when(F.col("_imputed").isNotNull(), "DERIVED_FROM_IMPUTED").otherwise("DERIVED_FROM_OBSERVED")
    return out.withColumns({"source": source, "imputed_fields": F.when(known, F.coalesce("_imputed", F.array().cast("array<string>")))}).drop("_imputed")


def mature(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors of forecasts (keys, origin_date, target_date, expert, prediction) whose truth (keys, target_date, y_true) has arrived."""
    out = forecasts.filter(F.col("prediction").isNotNull()).join(actuals.filter(F.col("y_true").isNotNull()), [*keys, "target_date"])
    return out.withColumn("error", F.col("prediction") - F.col("y_true")).withColumn("sq_error", F.col("error") * F.col("error"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each of keys: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_new(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of new to append: the first of each of keys that existing doesn't have."""
    return first_of(new, keys, order).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def merge_maps(old: str, new: str):
    """Entries of two maps; new ones win, a null among them doesn't."""
    return F.map_zip_with(F.col(old), F.col(new), lambda k, o, n: F.coalesce(n, o))
