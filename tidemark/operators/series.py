"""Time-series operators over keyed series: every window is partitioned by the keys.

Rolling windows count rows, not days; the calendar forms (densify, gaps) say so. Windows of one call share keys and order, so that a
frame of dozens of features takes one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import array_mad, array_median


def by(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _past(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ahead(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.currentRow, Window.unboundedFollowing)


def interpolate(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Adds the columns' values with gaps filled in a straight line by row position; the ends take the nearest value. columns: old to new."""
    w = by(keys, order)
    df = df.withColumn("_pos", F.row_number().over(w))
    for c, new in columns.items():
        there = F.when(F.col(c).isNotNull(), F.struct("_pos", F.col(c).cast("double").alias("v")))
        before, after = F.last(there, ignorenulls=True).over(_past(w)), F.first(there, ignorenulls=True).over(_ahead(w))
        df = df.withColumns({"_b": before, "_a": after})
        share = F.try_divide(F.col("_pos") - F.col("_b._pos"), F.col("_a._pos") - F.col("_b._pos"))
        line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share
        df = df.withColumn(new, F.coalesce(F.col(c).cast("double"), line, F.col("_b.v"), F.col("_a.v"))).drop("_b", "_a")
    return df.drop("_pos")


def fill_both_ways(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """The last value, or before any the first one to come."""
    w = by(keys, order)
    return df.withColumns({new: F.coalesce(F.last(c, ignorenulls=True).over(_past(w)), F.first(c, ignorenulls=True).over(_ahead(w))) for c, new in columns.items()})


def rolling_mean(c: str, w: WindowSpec, rows: int) -> Column:
    return F.avg(c).over(w.rowsBetween(-(rows - 1), 0))


def rolling_std(c: str, w: WindowSpec, rows: int) -> Column:
    """Sample standard deviation; 0 where it isn't defined."""
    return F.coalesce(F.stddev_samp(c).over(w.rowsBetween(-(rows - 1), 0)), F.lit(0.0))


def lagged(c: str, w: WindowSpec, rows: int, head: tuple[Column, Column] | None = None) -> Column:
    """The value rows before; at the head the first value, null in series of at most that many rows. head: the series' length and first value, where known."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, first = head or (F.count(F.lit(1)).over(whole), F.first(c).over(whole))
    return F.coalesce(F.lag(c, rows).over(w), F.when(n > rows, first))


def features(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], *, loads: Sequence[str] = (), windows: Sequence[int] = (7, 14, 30), lags: Sequence[int] = (1, 7, 14), retention: Sequence[int] = (5, 10), heads: Mapping[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """All rolling, lag and retention-load features in one projection. heads: length and first value of the series, for each column, where known."""
    w = by(keys, order)
    new = {f"{c}_rmean{n}": rolling_mean(c, w, n) for c in columns for n in windows}
    new |= {f"{c}_rstd{n}": rolling_std(c, w, n) for c in columns for n in windows}
    new |= {f"{c}_lag{n}": lagged(c, w, n, (heads or {}).get(c)) for c in columns for n in lags}
    new |= {f"{c}_load{n}": rolling_mean(c, w, n) for c in loads for n in retention}
    return df.select("*", *(e.alias(k) for k, e in new.items()))


def densify(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """A row for each day from a key's first to its last; other columns are null on days without one."""
    days = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = days.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [*keys, date], "left")


def sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], *, target: str | None = None, rows: int = 14) -> DataFrame:
    """x: the last rows' columns as an array of arrays, for each row with a whole window and, if target is named, a target."""
    w = by(keys, order).rowsBetween(-(rows - 1), 0)
    out = df.withColumn("x", F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(w)).filter(F.size("x") == rows)
    return out.filter(F.col(target).isNotNull()) if target else out


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Change against the row before; null where either is."""
    w = by(keys, order)
    return df.withColumns({new: F.col(c) - F.lag(c).over(w) for c, new in columns.items()})


def direction(a: str, b: str) -> Column:
    """UP or DOWN if all known changes of both sides are, UNKNOWN without one, else MIXED."""
    known = F.array_compact(F.array(a, b))
    return F.when(F.size(known) == 0, "UNKNOWN").when(F.forall(known, lambda x: x > 0), "UP").when(F.forall(known, lambda x: x < 0), "DOWN").otherwise("MIXED")


def robust_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], *, rows: int = 7, least: int = 3) -> DataFrame:
    """For each column c: c_base (median of the rows before), c_change, c_change_pct, c_direction, c_notable."""
    w = by(keys, order).rowsBetween(-rows, -1)
    df = df.withColumns({f"_{c}_h": F.collect_list(c).over(w) for c in columns})
    df = df.withColumns({f"_{c}_m": array_median(F.col(f"_{c}_h")) for c in columns})
    new = {}
    for c in columns:
        h, m, v = F.col(f"_{c}_h"), F.col(f"_{c}_m"), F.col(c)
        known = v.isNotNull() & (F.size(h) >= least)
        change, mad = v - m, array_mad(h, m)
        far = F.when(mad > 0, F.abs(change) > 3 * 1.4826 * mad).otherwise(F.abs(change) > 1e-9 * F.greatest(F.lit(1.0), F.abs(m)))
        new |= {
            f"{c}_base": F.when(known, m),
            f"{c}_change": F.when(known, change),
            f"{c}_change_pct": F.when(known & (m != 0), F.try_divide(change, m) * 100),
            f"{c}_direction": F.when(known, F.when(change > 0, "UP").when(change < 0, "DOWN").otherwise("FLAT")).otherwise("UNKNOWN"),
            f"{c}_notable": F.coalesce(known & far, F.lit(False)),
        }
    return df.withColumns(new).drop(*(f"_{c}_{k}" for c in columns for k in "hm"))


def segments(df: DataFrame, keys: Sequence[str], date: str, value: str, *, days: int | None = 1) -> DataFrame:
    """Runs of rows with a value: segment, first, last, n. A run ends at a null and, with days, at a larger step in the calendar."""
    w = by(keys, [date])
    known = F.col(value).isNotNull()
    new = ~F.coalesce(F.lag(known).over(w), F.lit(False))
    if days is not None:
        new = new | (F.datediff(F.col(date), F.lag(date).over(w)) > days)
    rows = df.withColumn("_new", F.when(known & new, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(_past(w)).cast("long"))
    return rows.filter(known).groupBy(*keys, "segment").agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("n"))


def bridges(df: DataFrame, keys: Sequence[str], date: str, value: str, *, most: int = 2) -> DataFrame:
    """Neighbouring observed days with 1 to most missing days between them."""
    w = by(keys, [date])
    seen = df.filter(F.col(value).isNotNull()).select(*keys, F.col(date).alias("from_date"), F.lead(date).over(w).alias("to_date"))
    return seen.withColumn("missing", (F.datediff("to_date", "from_date") - 1).cast("long")).filter(F.col("missing").between(1, most))


def trailing_days(df: DataFrame, keys: Sequence[str], date: str, days: int = 14) -> DataFrame:
    """The rows of each key's last days, by the calendar."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    return df.join(last, list(keys)).filter(F.col(date) > F.date_sub("_last", days)).drop("_last")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows).drop("_n")


def years(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return df.select(*keys, F.year(date).cast("long").alias("year")).distinct()


def change_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 7) -> DataFrame:
    """change: the value minus the one some rows before; the change over one row where that many don't exist."""
    w = by(keys, order)
    return df.withColumn("change", F.coalesce(F.col(value) - F.lag(value, rows).over(w), F.col(value) - F.lag(value, 1).over(w)))


def last_observed(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Each key's last value, its date, and its age in days at the key's last row."""
    seen = F.when(F.col(value).isNotNull(), F.col(date))
    out = df.groupBy(*keys).agg(F.max_by(value, seen).alias("last_value"), F.max(seen).alias("last_date"), F.max(date).alias("_end"))
    return out.withColumn("age_days", F.datediff("_end", "last_date").cast("long")).drop("_end")


def coverage(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(value).alias("observed"), F.count("*").alias("rows"))
    return out.withColumn("coverage", F.col("observed") / F.col("rows"))
