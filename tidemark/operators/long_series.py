"""Operators on series of any length: a series is cut into ranges of rows, which are worked on by different tasks.

Bounded windows get a halo: a range also holds the rows next to it that its windows reach, which are dropped from the result
(``by_ranges``). What has no bound is a scan in two levels: each range gives a summary, the summaries of a series (a row for each range)
are scanned by a window of their own, and what they carry is joined back to the range's rows. Rows that are equal in keys and order stand
in any order, as in any window; keys may be null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import forecast, quality, series
from tidemark.operators.series import by
from tidemark.sources.store import written

#: Rows of a range.
ROWS = 100_000


def joined(df: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with the other columns of few, which has a row for each of on; nulls match nulls."""
    names = {c: f"_on_{i}" for i, c in enumerate(on)}
    few = few.select(*(F.col(c).alias(names.get(c, c)) for c in few.columns))
    match = F.lit(True)
    for c, other in names.items():
        match = match & F.col(c).eqNullSafe(F.col(other))
    return df.join(few, match).drop(*names.values())


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """df with _at, a row's place in its series from 0, and _range, _at div rows; written once.

    Places are counted in two levels too: in each task's part of the sorted rows, and over the parts' counts.
    """
    parts = written(df.repartitionByRange(*(F.col(c) for c in [*keys, *order])).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*keys).orderBy("_part")
    base = parts.groupBy(*keys, "_part").count().withColumn("_base", F.sum("count").over(w) - F.col("count")).drop("count")
    own = F.row_number().over(by([*keys, "_part"], order)) - 1
    at = joined(parts.withColumn("_at", own), base, [*keys, "_part"]).withColumn("_at", (F.col("_at") + F.col("_base")).cast("long"))
    return written(at.drop("_part", "_base").withColumn("_range", F.expr(f"_at div {rows}")))


def with_halo(at: DataFrame, rows: int, before: int, after: int = 0) -> DataFrame:
    """Rows of in_ranges, also copied to the ranges that need them as the rows before or after theirs; _own is a row's own range."""
    first = F.expr(f"greatest(_at - {after}, 0) div {rows}")
    last = F.expr(f"(_at + {before}) div {rows}")
    return at.withColumnRenamed("_range", "_own").withColumn("_range", F.explode(F.sequence(first, last)))


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_range") == F.col("_own")).drop("_range", "_own", "_at")


def by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], operator: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame], *, before: int = 0, after: int = 0, rows: int = ROWS) -> DataFrame:
    """operator(df, keys, order), made range by range. Its windows reach at most ``before`` rows back and ``after`` ahead, and it keeps
    the columns that it is given."""
    return without_halo(operator(with_halo(in_ranges(df, keys, order, rows), rows, before, after), [*keys, "_range"], order))


def features(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], *, rows: int = ROWS, windows: Sequence[int] = (7, 14, 30), lags: Sequence[int] = (1, 7, 14), retention: Sequence[int] = (5, 10), loads: Sequence[str] = ()) -> DataFrame:
    """series.features by ranges; the first value and the length of a series, which lags at its head need, are an aggregate."""
    at = in_ranges(df, keys, order, rows)
    head = at.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("_at") == 0, F.col(c))).alias(f"_first_{c}") for c in columns))
    frame = with_halo(joined(at, head, keys), rows, max([*windows, *retention, *(k + 1 for k in lags), 1]) - 1)
    out = series.features(frame, [*keys, "_range"], order, columns, loads=loads, windows=windows, lags=lags, retention=retention, heads={c: (F.col("_n"), F.col(f"_first_{c}")) for c in columns})
    return without_halo(out.drop("_n", *(f"_first_{c}" for c in columns)))


def robust_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], *, rows: int = ROWS, history: int = 7, least: int = 3) -> DataFrame:
    """series.robust_trend by ranges."""
    return by_ranges(df, keys, order, lambda f, k, o: series.robust_trend(f, k, o, columns, rows=history, least=least), before=history, rows=rows)


def fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], straight: Mapping[str, str], held: Mapping[str, str] | None = None, *, rows: int = ROWS) -> DataFrame:
    """series.interpolate (columns of straight) and series.fill_both_ways (of held) as a scan in two levels.

    A range's summary is its first and last values and their places; the nearest of other ranges are carried to its rows.
    """
    held = held or {}
    names = list(dict.fromkeys([*straight, *held]))
    at = in_ranges(df, keys, order, rows)
    there = {c: F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).alias("v"))) for c in names}
    ends = at.groupBy(*keys, "_range").agg(*(F.max(x).alias(f"_l{i}") for i, x in enumerate(there.values())), *(F.min(x).alias(f"_f{i}") for i, x in enumerate(there.values())))
    w = Window.partitionBy(*keys).orderBy("_range")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(*keys, "_range", *(F.last(f"_l{i}", ignorenulls=True).over(back).alias(f"_b{i}") for i in range(len(names))), *(F.first(f"_f{i}", ignorenulls=True).over(ahead).alias(f"_a{i}") for i in range(len(names))))
    out = joined(at, carry, [*keys, "_range"])
    own = by([*keys, "_range"], order)
    past, coming = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    near = {}
    for i, (c, x) in enumerate(there.items()):
        near |= {f"_b{i}": F.coalesce(F.last(x, ignorenulls=True).over(past), F.col(f"_b{i}")), f"_a{i}": F.coalesce(F.first(x, ignorenulls=True).over(coming), F.col(f"_a{i}"))}
    out = out.select(*(c for c in out.columns if c not in near), *(e.alias(k) for k, e in near.items()))
    new = {}
    for i, c in enumerate(names):
        b, a = F.col(f"_b{i}"), F.col(f"_a{i}")
        if c in straight:
            bv, av = b["v"].cast("double"), a["v"].cast("double")
            line = bv + (av - bv) * F.try_divide(F.col("_at") - b["_at"], a["_at"] - b["_at"])
            new[straight[c]] = F.coalesce(F.col(c).cast("double"), line, bv, av)
        if c in held:
            new[held[c]] = F.coalesce(b["v"], a["v"])
    return out.withColumns(new).drop("_at", "_range", *near)


def densify(df: DataFrame, keys: Sequence[str], date: str, *, rows: int = ROWS) -> DataFrame:
    """series.densify as a scan: each row brings the days up to the next row's, which may be the first of the next range."""
    at = in_ranges(df.filter(F.col(date).isNotNull()), keys, [date], rows)
    first = at.groupBy(*keys, "_range").agg(F.min(date).alias("_first"))
    first = first.select(*keys, "_range", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")).alias("_next"))
    out = joined(at, first, [*keys, "_range"])
    next_day = F.coalesce(F.lead(date).over(by([*keys, "_range"], [date])), F.col("_next"))
    out = out.withColumn("_next", next_day).withColumn("_day", F.explode(F.sequence(F.col(date), F.greatest(F.col(date), F.coalesce(F.date_sub("_next", 1), F.col(date))))))
    same = F.col("_day") == F.col(date)
    others = [c for c in df.columns if c not in [*keys, date]]
    return out.select(*keys, F.col("_day").alias(date), *(F.when(same, F.col(c)).alias(c) for c in others))


def kinetic_state(df: DataFrame, keys: Sequence[str], date: str, load: str, k: float, *, rows: int = ROWS) -> DataFrame:
    """forecast.kinetic_state by ranges: the kernel ends at a thousandth, so that the halo is as long as the kernel."""
    return by_ranges(df, keys, [date], lambda f, own, _: forecast.kinetic_state(f, own, date, load, k), before=len(forecast.kernel(k)) - 1, rows=rows)


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), F.lit(n))


def _carried(ends: DataFrame, keys: Sequence[str], tail: str, n: int) -> Column:
    """The last n of the values that the ranges before hold: of ranges that have any, n are enough."""
    w = Window.partitionBy(*keys, F.col(tail).isNull()).orderBy("_range").rowsBetween(-n, -1)
    return _last(F.flatten(F.collect_list(tail).over(w)), n)


def grade_history(cells: DataFrame, keys: Sequence[str], order: Sequence[str], *, flat: str = "flatline", rows: int = ROWS) -> DataFrame:
    """quality.grade_history by ranges.

    Histories count valid cells, however far back they stand: a range's summary holds its last ones, and the ranges before that hold any
    give what is missing. The last row of a range is the one before the next range's first. Flat runs that reach a range's end are
    joined: a run has one number over all ranges, and its lengths in them are added up.
    """
    n = quality.HISTORY
    own = [*keys, "_range"]
    w = by(own, order)
    ranges = Window.partitionBy(*keys).orderBy("_range")
    at = in_ranges(cells, keys, order, rows)
    held = by([*own, F.col("value").isNull()], order)
    local = at.withColumns({"_h": F.collect_list("value").over(held.rowsBetween(-n, -1)), "_hi": F.collect_list("value").over(held.rowsBetween(-(n - 1), 0)), "_before": F.lag("value").over(w)})
    ends = local.groupBy(*own).agg(F.max_by("value", "_at").alias("_end"), F.max_by("_hi", F.when(F.col("value").isNotNull(), F.col("_at"))).alias("_tail"))
    ends = ends.select(*own, F.lag("_end").over(ranges).alias("_end"), _carried(ends, keys, "_tail", n).alias("_carry"))
    local = joined(local, ends, own)
    before = F.when(F.col("_at") % rows == 0, F.col("_end")).otherwise(F.col("_before"))
    local = local.withColumns({"_h": _last(F.concat("_carry", "_h"), n), "_before": before}).drop("_hi", "_end", "_carry")
    same = F.coalesce(F.col(flat) & (F.col("value") == F.col("_before")), F.lit(False))
    local = written(local.withColumns({"_d": F.col("value") - F.col("_before"), "_new": F.when(same, 0).otherwise(1)}))
    moved = by([*own, F.col("_d").isNull()], order)
    local = local.withColumns({"_dh": F.collect_list("_d").over(moved.rowsBetween(-n, -1)), "_dhi": F.collect_list("_d").over(moved.rowsBetween(-(n - 1), 0)), "_run": F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    local = local.withColumn("_run_n", F.count("*").over(Window.partitionBy(*own, "_run")))
    ends = local.groupBy(*own).agg(
        F.max_by("_dhi", F.when(F.col("_d").isNotNull(), F.col("_at"))).alias("_tail"), F.sum("_new").alias("_runs"), F.count(F.when(F.col("_run") == 0, 1)).alias("_head_n"), F.max_by("_run_n", "_at").alias("_tail_n")
    )
    ends = ends.select(*own, "_runs", "_head_n", "_tail_n", (F.sum("_runs").over(ranges) - F.col("_runs")).alias("_base"), _carried(ends, keys, "_tail", n).alias("_carry"))
    # The first and the last run of each range, by numbers that count over all ranges; a range of one run has it as its first.
    border = ends.select(*own, F.inline(F.array(F.struct(F.col("_base").alias("_no"), F.col("_head_n").alias("_here")), F.struct((F.col("_base") + F.col("_runs")).alias("_no"), F.when(F.col("_runs") > 0, F.col("_tail_n")).otherwise(0).alias("_here")))), "_base")
    border = border.withColumn("_whole", F.sum("_here").over(Window.partitionBy(*keys, "_no")))
    border = border.groupBy(*own).agg(F.max(F.when(F.col("_no") == F.col("_base"), F.col("_whole"))).alias("_head_n"), F.max_by("_whole", "_no").alias("_tail_n"))
    local = joined(local, joined(ends.drop("_head_n", "_tail_n", "_base"), border, own), own)
    run_n = F.when(F.col("_run") == 0, F.col("_head_n")).when(F.col("_run") == F.col("_runs"), F.col("_tail_n")).otherwise(F.col("_run_n"))
    local = local.withColumns({"_dh": _last(F.concat("_carry", "_dh"), n), "_run_n": run_n})
    return quality.grade(local.drop("_dhi", "_before", "_new", "_run", "_runs", "_carry", "_head_n", "_tail_n", "_at", "_range"), flat)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, columns: Sequence[str], *, tie: Sequence[str] = (), strict: bool = True, rows: int = ROWS) -> DataFrame:
    """left with the columns of the last row of right of the same keys before its time (with strict=False: not after it).

    The two tables may have clocks of their own. Their rows are put in one order and cut into ranges, so that a busy key is worked on by
    many tasks; the last row of right is carried over ranges. Of rows of right at one time the last by ``tie`` counts. Rows of left
    without one, or without a time, get nulls; nulls in keys match each other.
    """
    own = [c for c in left.columns if c not in keys]
    # At one time, rows of left stand before those of right if these don't count for them, else behind.
    side = 0 if strict else 2
    cells = F.struct(*(F.col(c).alias(f"l{i}") for i, c in enumerate(own)))
    brought = F.struct(F.col(right_at).alias("at"), *(F.col(c).alias(f"r{i}") for i, c in enumerate(columns)))
    ties = F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(tie)))
    events = right.filter(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_t"), F.lit(1).alias("_side"), ties.alias("_tie"), F.lit(None).cast(left.select(cells).schema[0].dataType).alias("_left"), brought.alias("_right"))
    asked = left.select(*keys, F.col(at).cast(right.schema[right_at].dataType).alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast(events.schema["_tie"].dataType).alias("_tie"), cells.alias("_left"), F.lit(None).cast(events.schema["_right"].dataType).alias("_right"))
    order = ["_t", "_side", "_tie"]
    both = in_ranges(asked.unionByName(events), keys, order, rows)
    ends = both.groupBy(*keys, "_range").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_at"))).alias("_end"))
    back = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    both = joined(both, ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(back).alias("_carry")), [*keys, "_range"])
    past = by([*keys, "_range"], ["_at"]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.coalesce(F.last("_right", ignorenulls=True).over(past), F.col("_carry"))).filter(F.col("_left").isNotNull())
    taken = {c: (F.col(c) if c in keys else F.col(f"_left.l{own.index(c)}")) for c in left.columns}
    return found.select(*(e.alias(c) for c, e in taken.items()), *(F.col(f"_found.r{i}").alias(c) for i, c in enumerate(columns)))
