"""Forecasts: experts, past-only weights, blends, origins and the stored results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import forecast as P
from tidemark.operators import joins as J
from tidemark.operators import series as E
from tidemark.plans import inputs as I
from tidemark.plans.registry import query
from tidemark.sources.state import StateTable
from tidemark.sources.store import work_folder, written

KEYS = ["series_id", "target"]
FEATURES = ["x", "x7"]
K = 0.35
WEIGHTS = P.kernel(K)
CUT = "1996-01-01"
BY = "over (partition by series_id, target order by date)"

_STATE = " + ".join(f"coalesce(lag(x, {i}) {BY} * {w!r}, 0)" for i, w in enumerate(WEIGHTS))
_SEEN = " + ".join(f"case when lag(x, {i}) {BY} is null then 0 else {w!r} end" for i, w in enumerate(WEIGHTS))
#: Two targets of each series, the second one larger than the first.
DENSE = f"""{I.ORDER_DAILY}, span as (select series_id, min(date) as a, max(date) as b from order_daily group by 1),
days as (select series_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date from span),
dense0 as (select series_id, date, x, case when day(date) % 11 = 0 then null else y end as y0 from days left join order_daily using (series_id, date)),
dense as (select series_id, target, date, x, case target when 'methane' then y0 else round(y0 * 1.500371 + x, 4) end as y from dense0, (values ('methane'), ('biogas')) t(target)),
st0 as (select *, {_SEEN} as w, {_STATE} as s from dense),
st as (select *, w / {sum(WEIGHTS)!r} as coverage, case when w / {sum(WEIGHTS)!r} >= 0.9 then s / nullif(w, 0) end as state from st0)"""
EXPERTS = f"""{DENSE}, f0 as (select *, last_value(y ignore nulls) {BY[:-1]} rows between unbounded preceding and current row) as last,
  last_value(case when y is not null then date end ignore nulls) {BY[:-1]} rows between unbounded preceding and current row) as last_date, lag(x, 7) {BY} as x7 from st),
h0 as (select *, unnest(range(1, 8)) as horizon from f0),
h as (select h0.*, t.y as y_true from h0 left join dense t on t.series_id = h0.series_id and t.target = h0.target and t.date = h0.date + cast(horizon as integer)),
fit as (select series_id, target, horizon, regr_intercept(y_true, state) as f0, regr_slope(y_true, state) as f1, regr_intercept(y, state) as b0, regr_slope(y, state) as b1 from h where date < date '{CUT}' group by all),
rs as (select series_id, target, horizon, count(*) as n, sum(x) as sx, sum(x7) as sz, sum(y_true) as sy, sum(x * x) as sxx, sum(x * x7) as sxz, sum(x7 * x7) as szz, sum(x * y_true) as sxy, sum(x7 * y_true) as szy
  from h where date < date '{CUT}' and x is not null and x7 is not null and y_true is not null group by all),
rc as (select *, sxx - sx * sx / n + 1 as a, sxz - sx * sz / n as b, szz - sz * sz / n + 1 as c, sxy - sx * sy / n as p, szy - sz * sy / n as q from rs),
ridge as (select series_id, target, horizon, (p * c - q * b) / (a * c - b * b) as c1, (q * a - p * b) / (a * c - b * b) as c2, sx / n as mx, sz / n as mz, sy / n as my from rc),
e0 as (select *, greatest(0, f0 + f1 * state) as m1f, b0 + b1 * state as now, my + c1 * (x - mx) + c2 * (x7 - mz) as rp from h left join fit using (series_id, target, horizon) left join ridge using (series_id, target, horizon)),
ex as (select series_id, target, date as origin_date, horizon, cast(date + cast(horizon as integer) as date) as target_date, y_true, y is not null as observed, date_diff('day', last_date, date) as age, unnest(['B10', 'B11', 'M1F', 'M2', 'RIDGE']) as expert,
  unnest([y, last, case when state is not null and f0 is not null then m1f end, case when y is not null and state is not null and f0 is not null then greatest(0, m1f + (y - now) * exp(-horizon / 5.0)) end, case when rp is not null then greatest(0, rp) end]) as prediction from e0),
experts as (select * from ex where prediction is not null)"""
ERRORS = f"""{EXPERTS}, errors as (select *, prediction - y_true as error, (prediction - y_true) ** 2 as sq_error from experts where y_true is not null)"""
RUN = "over (partition by series_id, target, horizon, expert order by day, kind)"
RUN_ALL = "over (partition by series_id, target, horizon order by day, kind)"
PAST = f"""{ERRORS}, arrivals as (select series_id, target, horizon, expert, target_date as day, 0 as kind, sq_error as e2, null as yt, target_date as came, null as origin_date, null as target_date, null as observed, null as age, null as prediction from errors
  union all select distinct series_id, target, horizon, null, target_date, 0, null, y_true, null, null, null, null, null, null from errors
  union all select series_id, target, horizon, expert, origin_date, 1, null, null, null, origin_date, target_date, observed, age, prediction from experts),
run as (select *, count(e2) {RUN} as n, avg(e2) {RUN} as mse, max(came) {RUN} as last_target, case when count(yt) {RUN_ALL} >= 2 then var_pop(yt) {RUN_ALL} else 1.0 end as truth_var from arrivals),
past as (select * from run where kind = 1)"""
ONE = "over (partition by series_id, target, origin_date, horizon)"
BLEND = f"""{PAST}, raw as (select *, greatest(1e-12, 1e-8 * truth_var) as epsilon, observed or expert not in ('B10', 'M2') as available, case when (observed or expert not in ('B10', 'M2')) and n >= 20 then 1 / (mse + greatest(1e-12, 1e-8 * truth_var)) else 0 end as raw,
  case when not (observed or expert not in ('B10', 'M2')) then null when observed then case expert when 'B10' then 0 when 'M2' then 1 when 'RIDGE' then 2 when 'M1F' then 3 else 4 end else case expert when 'B11' then 0 when 'RIDGE' then 1 when 'M1F' then 2 end end as place from past),
sums as (select *, sum(raw) {ONE} as total, min(place) {ONE} as first_place from raw),
weighted as (select *, case when total > 0 then raw / total when place = first_place then 1.0 else 0.0 end as weight, case when total > 0 then 'INVERSE_ERROR' when first_place is not null then 'FALLBACK' else 'NONE' end as method from sums),
blended as (select series_id, target, origin_date, horizon, target_date, greatest(0.0, sum(case when weight > 0 then weight * prediction end)) as prediction from weighted group by all)"""


def states(spark, d):
    """The densified series' two targets with some days' values missing, and their kinetic state."""
    dense = E.densify(I.order_daily(spark, d), ["series_id"], "date").withColumn("y", F.when(F.dayofmonth("date") % 11 != 0, F.col("y")))
    both = F.explode(F.array(F.struct(F.lit("methane").alias("target"), F.col("y")), F.struct(F.lit("biogas").alias("target"), F.round(F.col("y") * 1.500371 + F.col("x"), 4).alias("y"))))
    dense = dense.select("series_id", "date", "x", both.alias("t")).select("series_id", "t.target", "date", "x", "t.y")
    return P.kinetic_state(dense, KEYS, "date", "x", K)


def origin_rows(spark, d):
    """Each day at each horizon, with the last observed value, the features, and what the target day turned out to be.

    Days are written once, since the fit and the forecasts both read them; a horizon's rows are made in reading.
    """
    w = E.by(KEYS, ["date"])
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    s = states(spark, d).withColumns({"last": F.last("y", ignorenulls=True).over(past), "last_date": F.last(F.when(F.col("y").isNotNull(), F.col("date")), ignorenulls=True).over(past), "x7": F.lag("x", 7).over(w)})
    return P.observed_ahead(s, KEYS, "date", "y", keep=written)


def expert_rows(spark, d):
    rows = origin_rows(spark, d)
    fits = P.fit_experts(rows.filter(F.col("origin_date") < F.lit(CUT).cast("date")), KEYS, "y", "state", FEATURES)
    return P.experts(rows, KEYS, "y", "state", fits, FEATURES)


def error_rows(spark, d):
    return expert_rows(spark, d).filter("y_true is not null").withColumn("sq_error", F.col("error") * F.col("error"))


def weighted(spark, d):
    return P.weights(P.past_errors(expert_rows(spark, d), KEYS), KEYS)


def blended(spark, d):
    return P.blend(weighted(spark, d), KEYS)


@query("e9_i2_kinetic_state", f"with {DENSE} select series_id, target, date, round(coverage, 6) as coverage, round(state, 6) as state from st")
def e9_i2_kinetic_state(spark, d):
    return states(spark, d).select(*KEYS, "date", F.round("coverage", 6).alias("coverage"), F.round("state", 6).alias("state"))


@query("i1_i4_experts", f"with {EXPERTS} select series_id, target, origin_date, horizon, target_date, expert, round(prediction, 4) as prediction from experts where expert <> 'RIDGE'")
def i1_i4_experts(spark, d):
    """Persistence, fit and fading-error experts of two targets at seven horizons."""
    return expert_rows(spark, d).filter("expert <> 'RIDGE'").select(*KEYS, "origin_date", "horizon", "target_date", "expert", F.round("prediction", 4).alias("prediction"))


SUMMED = ["x", "x1", "x7"]
_PAIRS = [(a, b) for i, a in enumerate([*SUMMED, "y"]) for b in [*SUMMED, "y"][i:]]


@query(
    "i5_ridge_sums",
    f"with {I.ORDER_DAILY}, r as (select series_id, x, lag(x, 1) over w as x1, lag(x, 7) over w as x7, y from order_daily window w as (partition by series_id order by date)) "
    f"select series_id, count(*) as n, {', '.join(f'round(sum({a}), 1) as s_{a}' for a in [*SUMMED, 'y'])}, {', '.join(f'round(sum({a} * {b}), 1) as s_{a}_{b}' for a, b in _PAIRS)} from r where x7 is not null group by 1",
)
def i5_ridge_sums(spark, d):
    w = E.by(["series_id"], ["date"])
    rows = I.order_daily(spark, d).select("series_id", "x", F.lag("x", 1).over(w).alias("x1"), F.lag("x", 7).over(w).alias("x7"), "y")
    s = P.ridge_sums(rows, ["series_id"], SUMMED, "y")
    return s.select("series_id", "n", *(F.round(c, 1).alias(c) for c in s.columns if c.startswith("s_")))


@query("i5_ridge_predictions", f"with {EXPERTS} select series_id, target, origin_date, horizon, round(prediction, 3) as prediction from experts where expert = 'RIDGE'")
def i5_ridge_predictions(spark, d):
    """Coefficients from aggregated sums, solved for each target and horizon, scored as a column expression."""
    return expert_rows(spark, d).filter("expert = 'RIDGE'").select(*KEYS, "origin_date", "horizon", F.round("prediction", 3).alias("prediction"))


@query("f4_matured_errors", f"with {ERRORS} select series_id, target, origin_date, horizon, target_date, expert, round(error, 4) as error, round(sq_error, 2) as sq_error from errors")
def f4_matured_errors(spark, d):
    """F4, by a join of forecasts with the days that have come."""
    e = expert_rows(spark, d)
    truths = states(spark, d).select(*KEYS, F.col("date").alias("target_date"), F.col("y").alias("y_true"))
    made = J.mature(e.drop("y_true", "error"), truths, KEYS)
    return made.select(*KEYS, "origin_date", "horizon", "target_date", "expert", F.round("error", 4).alias("error"), F.round("sq_error", 2).alias("sq_error"))


@query("g8_i16_past_errors", f"with {PAST} select series_id, target, origin_date, horizon, expert, n, round(mse, 2) as mse, last_target, round(truth_var, 2) as truth_var from past")
def g8_i16_past_errors(spark, d):
    p = P.past_errors(expert_rows(spark, d), KEYS)
    return p.select(*KEYS, "origin_date", "horizon", "expert", "n", F.round("mse", 2).alias("mse"), "last_target", F.round("truth_var", 2).alias("truth_var"))


@query("i7_i8_weights", f"with {BLEND} select series_id, target, origin_date, horizon, expert, round(weight, 6) as weight, method from weighted")
def i7_i8_weights(spark, d):
    return weighted(spark, d).select(*KEYS, "origin_date", "horizon", "expert", F.round("weight", 6).alias("weight"), "method")


#: The day whose weights come from stored sums, and the ends of the batches before it.
STATE_DAY, BATCHES = "2001-07-15", ("1997-12-31", "2000-06-30", "2001-07-15", "2001-07-15")


@query("i7_i16_stored_sums", f"with {BLEND} select series_id, target, origin_date, horizon, expert, round(weight, 6) as weight, method from weighted where origin_date = date '{STATE_DAY}'")
def i7_i16_stored_sums(spark, d):
    """G8, I7, I16 as state: errors are added batch by batch, the last one twice, and a day's weights need no history."""
    made = written(expert_rows(spark, d))
    table = StateTable(work_folder(spark, "errors"), f"series_id string, target string, horizon long, expert string, {P.ERROR_STATE}", (*KEYS, "horizon", "expert"))
    for end in BATCHES:
        P.advance(table, made.filter(F.col("target_date") <= F.lit(end).cast("date")), KEYS)
    rows = made.filter(F.col("origin_date") == F.lit(STATE_DAY).cast("date"))
    w = P.weights(P.errors_so_far(rows, table.read(spark), KEYS), KEYS)
    return w.select(*KEYS, "origin_date", "horizon", "expert", F.round("weight", 6).alias("weight"), "method")


@query("i9_blend", f"with {BLEND} select series_id, target, origin_date, horizon, target_date, round(prediction, 5) as prediction from blended")
def i9_blend(spark, d):
    return blended(spark, d).select(*KEYS, "origin_date", "horizon", "target_date", F.round("prediction", 5).alias("prediction"))


SERIES = ["series_id"]
_BY = "over (partition by series_id order by date)"
ORIGINS = f"""{I.USER_DAILY}, run as (select series_id, date, value, n, count(*) {_BY} as rows, date_diff('day', min(date) {_BY}, date) as days, lag(value, 2) {_BY} as v2 from user_daily),
cand as (select series_id, date as origin_date, list_filter([case when rows < 20 then 'INSUFFICIENT_ROWS' end, case when rows >= 20 and days < 19 then 'INSUFFICIENT_SPAN' end, case when v2 is null then 'NON_FINITE_FEATURE' end, case when not (n > 1) then 'NO_EXPERT' end], lambda r: r is not null) as reasons from run)"""


#: The same, with what is read more than once made once.
MADE_ONCE = EXPERTS.replace("dense as (", "dense as materialized (").replace("st as (", "st as materialized (").replace("h as (select h0", "h as materialized (select h0").replace("ex as (", "ex as materialized (")

#: Targets and horizons that an origin needs an expert for.
REQUIRED = [*(("methane", h) for h in range(1, 8)), ("biogas", 1)]
_NEEDED = ", ".join(f"'{t}:h{h}'" for t, h in REQUIRED)
#: Days of orders as candidates, whose load is known late in some series.
CANDIDATES = f"""{MADE_ONCE},
feats as (select series_id, date, x, lag(x, 1) {_BY} as x1, lag(x, 7) {_BY} as x7, case when date_diff('day', date, max(date) over (partition by series_id)) >= length(series_id) % 5 then x end as late from dense where target = 'methane'),
run as (select *, count(*) {_BY} as rows, date_diff('day', min(date) {_BY}, date) as days from feats where x is not null),
have as (select series_id, origin_date, list(distinct target || ':h' || horizon) as hs from ex where prediction is not null and (observed or expert not in ('B10', 'M2')) group by all),
first as (select r.series_id, r.date as origin_date, list_filter([case when rows < 20 then 'INSUFFICIENT_ROWS' end, case when rows >= 20 and days < 19 then 'INSUFFICIENT_SPAN' end, case when x1 is null or x7 is null or late is null then 'NON_FINITE_FEATURE' end], lambda r: r is not null) as reasons,
  list_transform(list_filter([{_NEEDED}], lambda k: not list_contains(coalesce(hs, []), k)), lambda k: 'NO_EXPERT:' || k) as missing from run r left join have h on h.series_id = r.series_id and h.origin_date = r.date),
cand as (select series_id, origin_date, case when len(reasons) = 0 then missing else reasons end as reasons from first)"""


def candidates(spark, d):
    w = E.by(SERIES, ["date"])
    days = states(spark, d).filter("target = 'methane'")
    late = F.when(F.datediff(F.max("date").over(Window.partitionBy(*SERIES)), F.col("date")) >= F.length("series_id") % 5, F.col("x"))
    days = days.withColumns({"x1": F.lag("x", 1).over(w), "x7": F.lag("x", 7).over(w), "late": late}).filter("x is not null")
    have = P.experts_at(expert_rows(spark, d), SERIES).withColumnRenamed("origin_date", "date")
    return P.origins(days.join(have, [*SERIES, "date"], "left"), SERIES, "date", ["x1", "x7", "late"], required=REQUIRED)


@query("i11_latest_origin", f"with {CANDIDATES} select series_id, max(case when len(reasons) = 0 then origin_date end) as origin_date from cand group by 1")
def i11_latest_origin(spark, d):
    """The newest day with rows, span, features, and an expert for every required target and horizon."""
    return P.latest_origin(candidates(spark, d), SERIES)


@query("i12_rejected_origins", f"with {CANDIDATES}, l as (select series_id, max(case when len(reasons) = 0 then origin_date end) as last from cand group by 1) select series_id, origin_date, array_to_string(reasons, ',') as reasons, case when last is null then case when len(list_filter(reasons, lambda r: starts_with(r, 'INSUFFICIENT'))) > 0 then 'INSUFFICIENT_HISTORY' else 'NO_FORECASTABLE_ORIGIN' end end as error from cand join l using (series_id) where last is null or origin_date > last")
def i12_rejected_origins(spark, d):
    return P.rejected(candidates(spark, d), SERIES).withColumn("reasons", F.array_join("reasons", ","))


@query("i13_unavailable", f"with {MADE_ONCE}, m as materialized (select series_id, target, origin_date, horizon, prediction from experts where expert = 'M2'), w as (select series_id, target, date as origin_date, unnest(range(1, 8)) as horizon from dense) select series_id, target, origin_date, horizon, case when prediction is null then 'UNAVAILABLE' else 'AVAILABLE' end as status from w left join m using (series_id, target, origin_date, horizon)")
def i13_unavailable(spark, d):
    wanted = P.horizons(states(spark, d).select(*KEYS, "date"), "date").drop("target_date")
    made = expert_rows(spark, d).filter("expert = 'M2'").select(*KEYS, "origin_date", "horizon", "prediction")
    return P.with_unavailable(wanted, made, KEYS).select(*KEYS, "origin_date", "horizon", "status")


CUSTOMER_DAILY = "customer_daily as (select cast(o_custkey as varchar) as series_id, cast(o_orderdate as date) as date, round(sum(o_totalprice), 2) as value, count(*) as n from orders group by 1, 2)"


@query(
    "i13_unavailable_series",
    f"""with {ORIGINS.replace(I.USER_DAILY, CUSTOMER_DAILY).replace("from user_daily", "from customer_daily")}, k as (select *, count(*) over (partition by series_id) as rows, count(*) filter (where len(reasons) = 0) over (partition by series_id) as good, row_number() over (partition by series_id order by origin_date desc) as rn from cand)
select series_id, case when max(rows) < 20 then 'INSUFFICIENT_HISTORY' else 'NO_FORECASTABLE_ORIGIN' end as status, string_agg(cast(origin_date as varchar) || ': ' || array_to_string(reasons, ','), '; ' order by rn) as reason, cast(null as date) as origin_date, cast(0 as integer) as n_predictions
from k where good = 0 and rn <= 10 group by series_id""",
)
def i13_unavailable_series(spark, d):
    """Customers without an origin, with the status, why their ten newest days were rejected, and an empty list of predictions."""
    o = I.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("n"))
    o = o.withColumn("v2", F.lag("value", 2).over(E.by(SERIES, ["date"])))
    found = P.origins(o, SERIES, "date", ["value", "v2"], F.col("n") > 1)
    return P.unavailable(found, SERIES).select("series_id", "status", "reason", "origin_date", F.size("predictions").alias("n_predictions"))


@query("i14_latest_runs", "select o_custkey as dataset_id, o_orderpriority as model_version, o_orderkey as run_id, o_orderdate as created_at from orders qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) = 1")
def i14_latest_runs(spark, d):
    """The last stored run of each dataset and model version."""
    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderpriority").alias("model_version"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return P.latest_runs(o, ["dataset_id", "model_version"])


@query("i15_reusable_runs", f"with {I.ORDER_DAILY}, l as (select series_id, max(date) as latest from order_daily group by 1), r as (select o_orderpriority as series_id, o_orderkey as run_id, cast(o_orderdate as date) as origin_date, o_orderkey % 3 <> 0 as has_gas from orders) select run_id, series_id from r join l using (series_id) where has_gas and origin_date = latest")
def i15_reusable_runs(spark, d):
    latest = I.order_daily(spark, d).groupBy("series_id").agg(F.max("date").alias("origin_date"))
    runs = I.table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("origin_date"), (F.col("o_orderkey") % 3 != 0).alias("has_gas"))
    return runs.filter("has_gas").join(latest, ["series_id", "origin_date"]).select("run_id", "series_id")


@query("i17_complete", f"with {BLEND} select series_id, target, origin_date, count(*) = 7 and bool_and(prediction is not null) as complete from blended group by all")
def i17_complete(spark, d):
    return P.complete(blended(spark, d), KEYS)


LAST = "select series_id, target, date as origin_date, last, last_date from f0"


def last_actuals(spark, d):
    past = E.by(KEYS, ["date"]).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("y").isNotNull(), F.struct("y", "date")), ignorenulls=True).over(past)
    s = states(spark, d).select(*KEYS, F.col("date").alias("origin_date"), seen.alias("s"))
    return s.select(*KEYS, "origin_date", F.col("s.y").alias("last_actual"), F.col("s.date").alias("last_date"))


@query("i18_e22_headline", f"with {BLEND}, l as ({LAST}), g as (select series_id, target, origin_date, max(case when horizon = 1 then prediction end) as day1, max(case when horizon = 7 then prediction end) as day7 from blended group by all) select series_id, target, origin_date, round(last, 4) as last_actual, round(day1, 5) as day1, round(day7, 5) as day7, round(day7 - last, 5) as change from g join l using (series_id, target, origin_date)")
def i18_e22_headline(spark, d):
    """The last value before an origin, the forecasts of the next day and of the seventh, and the change in a week."""
    h = P.headline(blended(spark, d), last_actuals(spark, d), KEYS)
    return h.select(*KEYS, "origin_date", F.round("last_actual", 4).alias("last_actual"), *(F.round(c, 5).alias(c) for c in ("day1", "day7", "change")))


@query("e22_bridge", f"with {BLEND}, l as ({LAST}) select series_id, target, origin_date, last_date as from_date, round(last, 4) as from_value, target_date as to_date, round(prediction, 5) as to_value from blended join l using (series_id, target, origin_date) where horizon = 1 and last is not null")
def e22_bridge(spark, d):
    """The segment from the last actual value to the first forecast."""
    b = P.bridge(blended(spark, d), last_actuals(spark, d), KEYS)
    return b.select(*KEYS, "origin_date", "from_date", F.round("from_value", 4).alias("from_value"), "to_date", F.round("to_value", 5).alias("to_value"))


@query("i19_audit", f"with {BLEND} select series_id, target, origin_date, horizon, expert, round(prediction, 5) as prediction, available, round(weight, 6) as weight, n, round(mse, 2) as mse, last_target, observed, age, round(epsilon, 9) as epsilon, method from weighted")
def i19_audit(spark, d):
    """Experts, availability, weights and error statistics behind each forecast; the audit's maps, entry by entry."""
    a = P.audit(weighted(spark, d), KEYS)
    rows = a.select(*KEYS, "origin_date", "horizon", "observed", "age", F.round("epsilon", 9).alias("epsilon"), "method", F.explode("experts").alias("expert", "e"))
    about = [F.round("e.prediction", 5).alias("prediction"), F.col("e.available"), F.round("e.weight", 6).alias("weight"), F.col("e.n"), F.round("e.mse", 2).alias("mse"), F.col("e.last_target")]
    return rows.select(*KEYS, "origin_date", "horizon", "expert", *about, "observed", "age", "epsilon", "method")


@query("a12_insert_new", "with n as (select o_custkey as target, cast(o_orderdate as date) as origin_date, min(o_orderkey) as run_id from orders group by all) select target, origin_date, run_id from n where not exists (select 1 from orders o where o.o_custkey = n.target and cast(o.o_orderdate as date) = n.origin_date and o.o_orderkey % 5 = 0)")
def a12_insert_new(spark, d):
    """The first new row of each key that isn't stored yet."""
    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("target"), F.to_date("o_orderdate").alias("origin_date"), F.col("o_orderkey").alias("run_id"))
    return J.insert_new(o.filter("run_id % 5 = 0"), o, ["target", "origin_date"], ["run_id"])
