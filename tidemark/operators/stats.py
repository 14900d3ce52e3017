"""Correlations, profiles, rankings and metrics, each in one pass over its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import BANDS, ratio_band
from tidemark.operators.series import by, rolling_mean


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows that have both; null without spread or rows. corr() raises on a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _long(one: DataFrame, keys: Sequence[str], names: Sequence[int], name: str) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias(name), F.col(f"_{n}").alias("r")) for n in names)))
    return one.select(*keys, cells.alias("c")).select(*keys, f"c.{name}", "c.r")


def lag_correlation(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, lags: Sequence[int] = range(22)) -> DataFrame:
    """lag, r: correlation of y with x some rows before; all lags in one window and one aggregate."""
    w = by(keys, order)
    wide = df.select(*keys, F.col(y).alias("_y"), *(F.lag(x, k).over(w).alias(f"_x{k}") for k in lags))
    return _long(wide.groupBy(*keys).agg(*(pearson(F.col(f"_x{k}"), F.col("_y")).alias(f"_{k}") for k in lags)), keys, lags, "lag")


def window_correlation(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, windows: Sequence[int] = (1, 3, 5, 7, 10, 14, 21, 30)) -> DataFrame:
    """window, r: correlation of y with the rolling mean of x."""
    w = by(keys, order)
    wide = df.select(*keys, F.col(y).alias("_y"), *(rolling_mean(x, w, k).alias(f"_x{k}") for k in windows))
    return _long(wide.groupBy(*keys).agg(*(pearson(F.col(f"_x{k}"), F.col("_y")).alias(f"_{k}") for k in windows)), keys, windows, "window")


def spearman(df: DataFrame, keys: Sequence[str], y: str, variables: Sequence[str]) -> DataFrame:
    """variable, r: rank correlation with y, ties at their mean rank, over rows that have both."""
    rows = df.select(*keys, F.col(y).cast("double").alias("_y"), *(F.col(v).cast("double").alias(v) for v in variables))
    rows = rows.unpivot([*keys, "_y"], list(variables), "variable", "_x").dropna(subset=["_x", "_y"])
    part = [*keys, "variable"]

    def ranked(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*part).orderBy(c)) + (F.count("*").over(Window.partitionBy(*part, c)) - 1) / 2

    rows = rows.withColumns({"_rx": ranked("_x"), "_ry": ranked("_y")})
    return rows.groupBy(*part).agg(pearson(F.col("_rx"), F.col("_ry")).alias("r"))


def band_shares(df: DataFrame, keys: Sequence[str], ratio: str) -> DataFrame:
    """band, days, pct (of rows with a ratio)."""
    n = df.filter(F.col(ratio).isNotNull()).groupBy(*keys, ratio_band(ratio).alias("band")).agg(F.count("*").alias("days"))
    return n.withColumn("pct", F.round(100 * F.col("days") / F.sum("days").over(Window.partitionBy(*keys)), 1)) if keys else n


def class_counts(df: DataFrame, keys: Sequence[str], column: Column, classes: Sequence[str] = BANDS) -> DataFrame:
    """class, position, n: every class in order, with 0 where there is none."""
    one = df.groupBy(*keys).agg(*(F.count(F.when(column == c, 1)).alias(c) for c in classes))
    cells = F.posexplode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in classes)))
    return one.select(*keys, cells.alias("position", "c")).select(*keys, "c.class", F.col("position").cast("long").alias("position"), "c.n")


def best(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """The row of the highest score, the first by tie among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def regression_metrics(df: DataFrame, keys: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """n, r2, rmse, mae over rows that have both."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    e = F.col(prediction) - F.col(truth)
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(e * e).alias("_se"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("_v"))
    return s.select(*keys, "n", (1 - F.try_divide(F.col("_se"), F.col("_v") * F.col("n"))).alias("r2"), F.sqrt(F.col("_se") / F.col("n")).alias("rmse"), "mae")


def standardise(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], eps: float = 1e-8) -> DataFrame:
    """(value - mean) / (population deviation + eps) within each key."""
    w = Window.partitionBy(*keys)
    return df.withColumns({new: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + eps) for c, new in columns.items()})


def profile(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("rows"))


def top_by_priority(df: DataFrame, keys: Sequence[str], priority: str, order: str, most: int = 3) -> DataFrame:
    """The first rows by priority, then order, numbered."""
    w = Window.partitionBy(*keys).orderBy(priority, order)
    return df.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= most)
