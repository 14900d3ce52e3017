"""One long series, cut into ranges: the operators of series, quality and forecast on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import long_series as L
from tidemark.operators import quality as C
from tidemark.operators import ranks as R
from tidemark.plans import inputs as I
from tidemark.plans import quality_plans as Q
from tidemark.plans.registry import query

#: Rows of a range: small, so that the given tables have many.
ROWS = 700
KEYS, ORDER = ["series_id"], ["event_id"]
BY = "over (order by event_id{})"
PAST, AHEAD = BY.format(" rows between unbounded preceding and current row"), BY.format(" rows between current row and unbounded following")
K = 0.35
WEIGHTS = L.forecast.kernel(K)


def last(n: int, to: str = "current row") -> str:
    return BY.format(f" rows between {n} preceding and {to}")


@query(
    "e1_e2_long_series",
    f"""with {I.ONE_SERIES},
p as (select *, row_number() {BY.format('')} as pos from one_series),
b as (select *, last_value(case when value is not null then pos end ignore nulls) {PAST} as bp, last_value(value ignore nulls) {PAST} as bv,
  first_value(case when value is not null then pos end ignore nulls) {AHEAD} as ap, first_value(value ignore nulls) {AHEAD} as av from p)
select event_id, round(coalesce(value, bv + (av - bv) * (pos - bp) / nullif(ap - bp, 0), bv, av), 6) as straight, coalesce(bv, av) as held from b""",
)
def e1_e2_long_series(spark, d):
    """E1, E2 as a scan in two levels."""
    f = L.fill(I.one_series(spark, d), KEYS, ORDER, {"value": "straight"}, {"value": "held"}, rows=ROWS)
    return f.select("event_id", F.round("straight", 6).alias("straight"), "held")


_MEANS = ", ".join(f"round(avg(load) {last(n - 1)}, 7) as load_rmean{n}, round(coalesce(stddev_samp(load) {last(n - 1)}, 0.0), 7) as load_rstd{n}" for n in (7, 14, 30))
_LOADS = ", ".join(f"round(avg(value) {last(n - 1)}, 7) as value_load{n}" for n in (5, 10))
_LAGS = ", ".join(f"coalesce(lag(load, {n}) {BY.format('')}, case when count(*) over () > {n} then first_value(load) {BY.format('')} end) as load_lag{n}" for n in (1, 7, 14))


@query("e3_e7_long_series", f"with {I.ONE_SERIES} select event_id, {_MEANS}, {_LOADS}, {_LAGS} from one_series")
def e3_e7_long_series(spark, d):
    """E3 to E7 by ranges with a halo of 29 rows."""
    f = L.features(I.one_series(spark, d), KEYS, ORDER, ["load"], loads=["value"], rows=ROWS)
    return f.select("event_id", *(F.round(c, 7).alias(c) for c in f.columns if "_r" in c or "_load" in c), *(c for c in f.columns if "_lag" in c))


@query(
    "e13_long_series",
    f"""with {I.ONE_SERIES},
h as (select event_id, value, list(value) filter (where value is not null) {last(7, '1 preceding')} as h from one_series),
b as (select *, case when value is not null and len(h) >= 3 then list_median(h) end as base from h),
m as (select *, list_median(list_transform(h, lambda v: abs(v - base))) as mad, value - base as change from b)
select event_id, round(base, 6) as base, round(change, 6) as change, coalesce(case when mad > 0 then abs(change) > 3 * 1.4826 * mad else abs(change) > 1e-9 * greatest(1.0, abs(base)) end, false) as notable from m""",
)
def e13_long_series(spark, d):
    """E13 by ranges with a halo of seven rows."""
    t = L.robust_trend(I.one_series(spark, d), KEYS, ORDER, ["value"], rows=ROWS)
    return t.select("event_id", F.round("value_base", 6).alias("base"), F.round("value_change", 6).alias("change"), F.col("value_notable").alias("notable"))


_STATE = " + ".join(f"coalesce(lag(load, {i}) over (order by date) * {w!r}, 0)" for i, w in enumerate(WEIGHTS))
_SEEN = " + ".join(f"case when lag(load, {i}) over (order by date) is null then 0 else {w!r} end" for i, w in enumerate(WEIGHTS))


@query(
    "e8_e9_long_series",
    f"""with {I.ONE_SERIES},
days as (select cast(unnest(generate_series((select min(date) from one_series), (select max(date) from one_series), interval 1 day)) as date) as date),
s as (select date, {_SEEN} as w, {_STATE} as s from days left join one_series using (date))
select date, round(w / {sum(WEIGHTS)!r}, 6) as coverage, round(case when w / {sum(WEIGHTS)!r} >= 0.9 then s / nullif(w, 0) end, 6) as state from s""",
)
def e8_e9_long_series(spark, d):
    """E8 as a scan, and E9 (I2) by ranges with a halo as long as the kernel."""
    days = L.densify(I.one_series(spark, d).select("series_id", "date", "load"), KEYS, "date", rows=ROWS)
    s = L.kinetic_state(days, KEYS, "date", "load", K, rows=ROWS)
    return s.select("date", F.round("coverage", 6).alias("coverage"), F.round("state", 6).alias("state"))


@query("c2_c4_long_series", f"with {Q.GRADED.replace('event_type as series_id', chr(39) + 'all' + chr(39) + ' as series_id')} select event_id, status, value from cells")
def c2_c4_long_series(spark, d):
    """C2 to C4 by ranges, with histories and flat runs carried over their ends."""
    cells = C.classify_cells(I.raw_cells(spark, d).withColumn("series_id", F.lit("all")))
    return L.grade_history(cells, KEYS, ORDER, rows=ROWS).select("event_id", "status", "value")


@query(
    "f5_as_of_join",
    """with r as (select user_id % 3 as k, date '1995-01-01' + cast(event_id * 7 % 2400 as integer) as day, event_id, value from events),
last as (select * from r qualify row_number() over (partition by k, day order by event_id desc) = 1),
l as (select o_orderkey, o_custkey % 4 as k, cast(o_orderdate as date) as day from orders)
select l.o_orderkey, l.k, last.event_id, last.value from l asof left join last on l.k = last.k and l.day > last.day""",
)
def f5_as_of_join(spark, d):
    """for each order the last event of its group before it, of another table and clock."""
    orders = I.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("k"), F.to_date("o_orderdate").alias("at"))
    events = I.table(spark, d, "events").select((F.col("user_id") % 3).alias("k"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") * 7 % 2400).cast("int")).alias("happened"), "event_id", "value")
    return L.as_of(orders, events, ["k"], "at", "happened", ["event_id", "value"], tie=["event_id"], rows=ROWS).drop("at")


MEASURES = ["l_quantity", "l_discount", "l_tax"]


@query(
    "g3_spearman_ranges",
    f"""with u as (unpivot (select l_linestatus, l_extendedprice as y, {', '.join(MEASURES)} from lineitem) on {', '.join(MEASURES)} into name variable value x),
k as (select * from u where x is not null and y is not null),
r as (select *, rank() over (partition by l_linestatus, variable order by x) + (count(*) over (partition by l_linestatus, variable, x) - 1) / 2 as rx,
  rank() over (partition by l_linestatus, variable order by y) + (count(*) over (partition by l_linestatus, variable, y) - 1) / 2 as ry from k)
select l_linestatus, variable, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) as r from r group by all""",
)
def g3_spearman_ranges(spark, d):
    """G3 over all line items: a few large groups with long ties, ranked in more ranges than there are groups."""
    r = R.spearman(I.table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice", MEASURES, parts=16)
    return r.withColumn("r", F.round("r", 6))
