"""Time series, derivations, joins and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import joins as J
from tidemark.operators import series as E
from tidemark.operators import stats as G
from tidemark.plans import inputs as I
from tidemark.plans.registry import query

W = "over (partition by series_id order by date{})"


def rows(n: int, to: str = "current row") -> str:
    return W.format(f" rows between {n} preceding and {to}")


@query("d_scalars", f"with {I.PANEL} select series_id, date, round(feed_A + feed_B, 6) as feed_AB, round(biogas_A + biogas_B, 6) as biogas_AB, case when ALK_A > 0 then round(VFA_A / ALK_A, 6) end as ratio_A, case when ALK_B > 0 then round(VFA_B / ALK_B, 6) end as ratio_B, round(biogas_A * purity_A / 100 + biogas_B * purity_B / 100, 3) as ch4, round(coalesce((temperature_A + temperature_B) / 2, temperature_A, temperature_B), 6) as temperature, case when VS_A - 1.1 is not null then greatest(0.0, round(VS_A - 1.1, 4)) end as vs_floor, round(VFA_A * 1.000371 / nullif(feed_B, 0), 4) as load_ratio from panel")
def d_scalars(spark, d):
    """Strict sums, guarded ratios, product sum, mean of usable sides, floor at zero."""
    p = I.panel(spark, d)
    return p.select(
        "series_id",
        "date",
        F.round(S.strict_sum("feed_A", "feed_B"), 6).alias("feed_AB"),
        F.round(S.strict_sum("biogas_A", "biogas_B"), 6).alias("biogas_AB"),
        F.round(S.positive_ratio("VFA_A", "ALK_A"), 6).alias("ratio_A"),
        F.round(S.positive_ratio("VFA_B", "ALK_B"), 6).alias("ratio_B"),
        F.round(S.product_sum(("biogas_A", "purity_A"), ("biogas_B", "purity_B")), 3).alias("ch4"),
        F.round(S.mean_present("temperature_A", "temperature_B"), 6).alias("temperature"),
        S.floor_zero(F.round(F.col("VS_A") - 1.1, 4)).alias("vs_floor"),
        F.round(S.ratio(F.col("VFA_A") * 1.000371, "feed_B"), 4).alias("load_ratio"),
    )


@query("d5_next_day_purity", f"with {I.PANEL} select series_id, date, case when biogas_A > 0 and biogas_B >= 0 and biogas_B <= biogas_A then round(100 * biogas_B / biogas_A, 4) end as purity, case when biogas_A > 0 and biogas_B >= 0 and biogas_B <= biogas_A then null else 'PHYSICAL_CONSISTENCY_FAILED' end as reason from panel")
def d5_next_day_purity(spark, d):
    purity, reason = S.next_day_purity("biogas_B", "biogas_A")
    return I.panel(spark, d).select("series_id", "date", F.round(purity, 4).alias("purity"), reason.alias("reason"))


@query("d7_reading_text", f"with {I.PANEL} select series_id, date, 'A ' || case when temperature_A is not null then printf('%.1f', round(temperature_A, 1)) else 'N/A' end || ' / B ' || case when temperature_B is not null then printf('%.1f', round(temperature_B, 1)) else 'N/A' end as text from panel")
def d7_reading_text(spark, d):
    p = I.panel(spark, d).withColumns({c: F.round(c, 1) for c in ("temperature_A", "temperature_B")})
    return p.select("series_id", "date", S.reading_text("temperature_A", "temperature_B", 1).alias("text"))


@query("d8_rounding", f"with {I.DAILY} select series_id, date, round(mean_value * 1.00371, 3) as three, round(value / 7.0037, 2) as two from daily")
def d8_rounding(spark, d):
    return I.daily(spark, d).select("series_id", "date", S.half_up(F.col("mean_value") * 1.00371, 3).alias("three"), S.half_up(F.col("value") / 7.0037, 2).alias("two"))


GAPPY = "gappy as (select series_id, date, case when day(date) % 5 in (1, 2) then null else value end as value from daily)"


def gappy(spark, d):
    return I.daily(spark, d).withColumn("value", F.when(~(F.dayofmonth("date") % 5).isin(1, 2), F.col("value")))


@query("e1_e2_fill", f"""with {I.DAILY}, {GAPPY}, p as (select *, row_number() {W.format('')} as pos from gappy),
b as (select *, last_value(case when value is not null then pos end ignore nulls) {W.format(' rows between unbounded preceding and current row')} as bp, last_value(value ignore nulls) {W.format(' rows between unbounded preceding and current row')} as bv,
first_value(case when value is not null then pos end ignore nulls) {W.format(' rows between current row and unbounded following')} as ap, first_value(value ignore nulls) {W.format(' rows between current row and unbounded following')} as av from p)
select series_id, date, round(coalesce(value, bv + (av - bv) * (pos - bp) / nullif(ap - bp, 0), bv, av), 4) as straight, coalesce(bv, av) as held from b""")
def e1_e2_fill(spark, d):
    g = E.interpolate(gappy(spark, d), ["series_id"], ["date"], {"value": "straight"})
    g = E.fill_both_ways(g, ["series_id"], ["date"], {"value": "held"})
    return g.select("series_id", "date", F.round("straight", 4).alias("straight"), "held")


_FEATURES = ", ".join([f"round(avg(value) {rows(n - 1)}, 7) as value_rmean{n}" for n in (7, 14, 30)] + [f"round(coalesce(stddev_samp(value) {rows(n - 1)}, 0.0), 7) as value_rstd{n}" for n in (7, 14, 30)] + [f"round(avg(mean_value) {rows(n - 1)}, 7) as mean_value_load{n}" for n in (5, 10)] + [f"coalesce(lag(value, {n}) {W.format('')}, case when count(*) over (partition by series_id) > {n} then first_value(value) {W.format('')} end) as value_lag{n}" for n in (1, 7, 14)])


@query("e3_e7_features", f"with {I.DAILY} select series_id, date, {_FEATURES} from daily")
def e3_e7_features(spark, d):
    """Rolling means and deviations, lags and retention loads in one projection over one exchange."""
    f = E.features(I.daily(spark, d), ["series_id"], ["date"], ["value"], loads=["mean_value"])
    names = [c for c in f.columns if "_rmean" in c or "_rstd" in c or "_load" in c]
    return f.select("series_id", "date", *(F.round(c, 7).alias(c) for c in names), *(c for c in f.columns if "_lag" in c))


@query("e8_densify", f"with {I.USER_DAILY}, span as (select series_id, min(date) as a, max(date) as b from user_daily group by 1), days as (select series_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date from span) select series_id, date, value from days left join user_daily using (series_id, date)")
def e8_densify(spark, d):
    return E.densify(I.user_daily(spark, d), ["series_id"], "date").select("series_id", "date", "value")


@query("e10_sequences", f"with {I.DAILY}, s as (select series_id, date, value, list(value) {rows(13)} as x, list(mean_value) {rows(13)} as y from daily) select series_id, date, cast(len(x) as bigint) as n, round(list_sum(x), 3) as total, round(y[1], 4) as first_mean from s where len(x) = 14 and value is not null")
def e10_sequences(spark, d):
    s = E.sequences(I.daily(spark, d), ["series_id"], ["date"], ["value", "mean_value"], target="value")
    total = F.aggregate("x", F.lit(0.0), lambda a, r: a + F.get(r, F.lit(0)))
    return s.select("series_id", "date", F.size("x").cast("long").alias("n"), F.round(total, 3).alias("total"), F.round(F.get(F.get("x", F.lit(0)), F.lit(1)), 4).alias("first_mean"))


@query("e11_e12_deltas", f"with {I.PANEL}, x as (select series_id, date, VFA_A - lag(VFA_A) {W.format('')} as a, VFA_B - lag(VFA_B) {W.format('')} as b from panel) select series_id, date, round(a, 6) as delta_A, round(b, 6) as delta_B, case when a is null and b is null then 'UNKNOWN' when coalesce(a, 1) > 0 and coalesce(b, 1) > 0 then 'UP' when coalesce(a, -1) < 0 and coalesce(b, -1) < 0 then 'DOWN' else 'MIXED' end as direction from x")
def e11_e12_deltas(spark, d):
    x = E.deltas(I.panel(spark, d), ["series_id"], ["date"], {"VFA_A": "a", "VFA_B": "b"})
    return x.select("series_id", "date", F.round("a", 6).alias("delta_A"), F.round("b", 6).alias("delta_B"), E.direction("a", "b").alias("direction"))


def trend_sql(source: str, columns) -> str:
    """CTEs trend0 and trend: source with the robust trend of its columns."""
    held = ", ".join(f"list({c}) filter (where {c} is not null) {rows(7, '1 preceding')} as {c}_h" for c in columns)
    base = ", ".join(f"case when {c} is not null and len({c}_h) >= 3 then list_median({c}_h) end as {c}_base" for c in columns)
    mad = ", ".join(f"list_median(list_transform({c}_h, lambda v: abs(v - {c}_base))) as {c}_mad, {c} - {c}_base as {c}_change" for c in columns)
    out = ", ".join(
        f"case when {c}_base <> 0 then {c}_change / {c}_base * 100 end as {c}_change_pct, case when {c}_base is null then 'UNKNOWN' when {c}_change > 0 then 'UP' when {c}_change < 0 then 'DOWN' else 'FLAT' end as {c}_direction, "
        f"coalesce(case when {c}_mad > 0 then abs({c}_change) > 3 * 1.4826 * {c}_mad else abs({c}_change) > 1e-9 * greatest(1.0, abs({c}_base)) end, false) as {c}_notable"
        for c in columns
    )
    return f"trend0 as (select *, {held} from {source}), trend1 as (select *, {base} from trend0), trend2 as (select *, {mad} from trend1), trend as (select *, {out} from trend2)"


@query("e13_robust_trend", f"with {I.DAILY}, {trend_sql('daily', ['value'])} select series_id, date, round(value_base, 4) as base, round(value_change, 4) as change, round(value_change_pct, 4) as change_pct, value_direction as direction, value_notable as notable from trend")
def e13_robust_trend(spark, d):
    t = E.robust_trend(I.daily(spark, d), ["series_id"], ["date"], ["value"])
    return t.select("series_id", "date", *(F.round(f"value_{c}", 4).alias(c) for c in ("base", "change", "change_pct")), F.col("value_direction").alias("direction"), F.col("value_notable").alias("notable"))


@query("e14_segments", f"with {I.USER_DAILY}, k as (select *, case when lag(date) {W.format('')} is null or date_diff('day', lag(date) {W.format('')}, date) > 1 then 1 else 0 end as new from user_daily), s as (select *, cast(sum(new) {W.format(' rows between unbounded preceding and current row')} as bigint) as segment from k) select series_id, segment, min(date) as first, max(date) as last, count(*) as n from s group by all")
def e14_segments(spark, d):
    return E.segments(I.user_daily(spark, d), ["series_id"], "date", "value")


@query("e15_bridges", f"with {I.USER_DAILY}, l as (select series_id, date as from_date, lead(date) {W.format('')} as to_date from user_daily where value is not null) select *, date_diff('day', from_date, to_date) - 1 as missing from l where date_diff('day', from_date, to_date) - 1 between 1 and 2")
def e15_bridges(spark, d):
    return E.bridges(I.user_daily(spark, d), ["series_id"], "date", "value")


@query("e16_trailing_days", f"with {I.USER_DAILY} select series_id, date, value from user_daily join (select series_id, max(date) as b from user_daily group by 1) using (series_id) where date > b - 14")
def e16_trailing_days(spark, d):
    return E.trailing_days(I.user_daily(spark, d), ["series_id"], "date").select("series_id", "date", "value")


@query("e17_last_rows", f"with {I.ORDER_DAILY} select series_id, date, y from (select *, row_number() over (partition by series_id order by date desc) as n from order_daily) where n <= 30")
def e17_last_rows(spark, d):
    return E.last_rows(I.order_daily(spark, d), ["series_id"], ["date"], 30).select("series_id", "date", "y")


@query("e17_year_slice", f"with {I.ORDER_DAILY} select series_id, date, y from order_daily where year(date) = 1996")
def e17_year_slice(spark, d):
    return I.order_daily(spark, d).filter(F.year("date") == 1996).select("series_id", "date", "y")


@query("e18_years", f"with {I.ORDER_DAILY} select distinct series_id, year(date) as year from order_daily")
def e18_years(spark, d):
    return E.years(I.order_daily(spark, d), ["series_id"], "date")


@query("e19_change_over_week", f"with {I.DAILY} select series_id, date, round(coalesce(value - lag(value, 7) {W.format('')}, value - lag(value, 1) {W.format('')}), 4) as change from daily")
def e19_change_over_week(spark, d):
    return E.change_over(I.daily(spark, d), ["series_id"], ["date"], "value").select("series_id", "date", F.round("change", 4).alias("change"))


@query("e20_last_observed", f"with {I.DAILY}, {GAPPY} select series_id, max_by(value, case when value is not null then date end) as last_value, max(case when value is not null then date end) as last_date, date_diff('day', max(case when value is not null then date end), max(date)) as age_days from gappy group by 1")
def e20_last_observed(spark, d):
    return E.last_observed(gappy(spark, d), ["series_id"], "date", "value")


@query("e21_coverage", f"with {I.DAILY}, {GAPPY} select series_id, count(value) as observed, count(*) as rows, round(count(value) / count(*), 6) as coverage from gappy group by 1")
def e21_coverage(spark, d):
    return E.coverage(gappy(spark, d), ["series_id"], "value").withColumn("coverage", F.round("coverage", 6))


@query("f1_left_join", f"with {I.DAILY}, {GAPPY} select g.series_id, g.date, g.value, x.n from gappy g left join (select * from daily where n > 60) x on g.series_id = x.series_id and g.date = x.date")
def f1_left_join(spark, d):
    """F1, A3: left equi join on the key and date."""
    return J.left_on_date(gappy(spark, d).select("series_id", "date", "value"), I.daily(spark, d).filter("n > 60"), ["series_id", "date"], ["n"])


@query("f2_misaligned", f"with {I.DAILY} select a.series_id, a.date, a.value as a_value, b.value as b_value from daily a join (select series_id, date, case when day(date) % 9 = 0 then round(value * 1.001, 4) else value end as value from daily) b using (series_id, date) where abs(a.value - b.value) > 1e-6 + 1e-5 * abs(b.value)")
def f2_misaligned(spark, d):
    a = I.daily(spark, d).select("series_id", "date", F.col("value").alias("a_value"))
    b = a.select("series_id", "date", F.when(F.dayofmonth("date") % 9 == 0, F.round(F.col("a_value") * 1.001, 4)).otherwise(F.col("a_value")).alias("b_value"))
    return J.misaligned(a, b, ["series_id", "date"], "a_value", "b_value")


CELLS = "cells as (select distinct event_type as series_id, cast(ts as date) as date, case event_id % 3 when 0 then 'biogas_A' when 1 then 'purity_A' else 'other' end as field from events where event_id % 13 = 0)"


def synth_cells(spark, d):
    e = I.table(spark, d, "events").filter(F.col("event_id") % 13 == 0)
    field = F.when(F.col("event_id") % 3 == 0, "biogas_A").when(F.col("event_id") % 3 == 1, "purity_A").otherwise("other")
    return e.select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"), field.alias("field")).distinct()


@query("f3_provenance", f"with {I.DAILY}, {GAPPY}, {CELLS}, i as (select series_id, date, list_sort(list(distinct field)) as f from cells where field in ('biogas_A', 'purity_A') group by all) select g.series_id, g.date, case when value is null then 'UNAVAILABLE' when f is not null then 'DERIVED_FROM_IMPUTED' else 'DERIVED_FROM_OBSERVED' end as source, case when value is not null then coalesce(array_to_string(f, ','), '') end as imputed from gappy g left join i using (series_id, date)")
def f3_provenance(spark, d):
    p = J.provenance(gappy(spark, d), synth_cells(spark, d), ["series_id", "date"], "value", ["biogas_A", "purity_A"])
    return p.select("series_id", "date", "source", F.array_join("imputed_fields", ",").alias("imputed"))


@query("f5_previous_row", f"with {I.USER_DAILY} select series_id, date, lag(date) {W.format('')} as previous_date, lag(value) {W.format('')} as previous_value from user_daily")
def f5_previous_row(spark, d):
    w = E.by(["series_id"], ["date"])
    return I.user_daily(spark, d).select("series_id", "date", F.lag("date").over(w).alias("previous_date"), F.lag("value").over(w).alias("previous_value"))


@query("f7_union", f"with {I.DAILY}, {I.USER_DAILY} select series_id, date, value from daily union all select series_id, date, value from user_daily")
def f7_union(spark, d):
    return I.daily(spark, d).select("series_id", "date", "value").unionByName(I.user_daily(spark, d).select("series_id", "date", "value"))


@query("f9_first_rows", "select user_id, cast(ts as date) as date, first(event_id order by ts, event_id) as event_id from events group by all")
def f9_first_rows(spark, d):
    e = I.table(spark, d, "events").withColumn("date", F.to_date("ts"))
    return J.first_of(e, ["user_id", "date"], ["ts", "event_id"]).select("user_id", "date", "event_id")


def _corr(x: str, y: str) -> str:
    a, b = f"case when {x} is not null and {y} is not null then {x} end", f"case when {x} is not null and {y} is not null then {y} end"
    return f"round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 5)"


_LAGS = ", ".join(f"lag(x, {k}) {W.format('')} as x{k}" for k in range(22))
_WINDOWS = (1, 3, 5, 7, 10, 14, 21, 30)
LAG_SQL = f"with {I.ORDER_DAILY}, l as (select series_id, y, {_LAGS} from order_daily) " + " union all ".join(f"select series_id, cast({k} as bigint) as lag, {_corr(f'x{k}', 'y')} as r from l group by 1" for k in range(22))
WINDOW_SQL = f"with {I.ORDER_DAILY}, l as (select series_id, y, " + ", ".join(f"avg(x) {rows(k - 1)} as x{k}" for k in _WINDOWS) + " from order_daily), r as (" + " union all ".join(f"select series_id, cast({k} as bigint) as w, {_corr(f'x{k}', 'y')} as r from l group by 1" for k in _WINDOWS) + ")"


@query("g1_lag_correlation", LAG_SQL)
def g1_lag_correlation(spark, d):
    return G.lag_correlation(I.order_daily(spark, d), ["series_id"], ["date"], "x", "y").withColumn("r", F.round("r", 5))


@query("g2_window_correlation", WINDOW_SQL + " select series_id, w, r from r")
def g2_window_correlation(spark, d):
    return G.window_correlation(I.order_daily(spark, d), ["series_id"], ["date"], "x", "y").select("series_id", F.col("window").alias("w"), F.round("r", 5).alias("r"))


@query("g6_best_window", WINDOW_SQL + " select series_id, w, r from r qualify row_number() over (partition by series_id order by r desc nulls last, w) = 1")
def g6_best_window(spark, d):
    return G.best(g2_window_correlation(spark, d), ["series_id"], "r", "w")


@query("g3_spearman", f"""with {I.PANEL}, u as (unpivot (select series_id, biogas_A, VFA_A, ALK_A, pH_A, VS_A from panel) on VFA_A, ALK_A, pH_A, VS_A into name variable value x),
k as (select * from u where x is not null and biogas_A is not null),
r as (select *, rank() over (partition by series_id, variable order by x) + (count(*) over (partition by series_id, variable, x) - 1) / 2 as rx, rank() over (partition by series_id, variable order by biogas_A) + (count(*) over (partition by series_id, variable, biogas_A) - 1) / 2 as ry from k)
select series_id, variable, {_corr('rx', 'ry')} as r from r group by all""")
def g3_spearman(spark, d):
    return G.spearman(I.panel(spark, d), ["series_id"], "biogas_A", ["VFA_A", "ALK_A", "pH_A", "VS_A"]).withColumn("r", F.round("r", 5))


BAND = "case when {0} < 0.30 then 'Stable' when {0} < 0.40 then 'Caution' when {0} < 0.80 then 'Unstable' when {0} >= 0.80 then 'Danger' end"


@query("g4_band_shares", f"with {I.PANEL}, b as (select series_id, {BAND.format('VFA_TA_A')} as band from panel where VFA_TA_A is not null), n as (select series_id, band, count(*) as days from b group by all) select *, round(100 * days / sum(days) over (partition by series_id), 1) as pct from n")
def g4_band_shares(spark, d):
    """Four bands of a ratio and their shares."""
    return G.band_shares(I.panel(spark, d), ["series_id"], "VFA_TA_A")


@query("g5_class_counts", f"with {I.PANEL}, c as (select unnest(['Stable', 'Caution', 'Unstable', 'Danger']) as class, unnest(cast([0, 1, 2, 3] as bigint[])) as position), s as (select distinct series_id from panel), b as (select series_id, {BAND.format('VFA_TA_A')} as class, count(*) as n from panel group by all) select series_id, class, position, coalesce(n, 0) as n from s cross join c left join b using (series_id, class)")
def g5_class_counts(spark, d):
    return G.class_counts(I.panel(spark, d), ["series_id"], S.ratio_band("VFA_TA_A"))


@query("g7_regression_metrics", f"with {I.DAILY}, p as (select *, lag(value, 1) {W.format('')} as prediction from daily), s as (select series_id, count(*) as n, sum((prediction - value) ** 2) as se, avg(abs(prediction - value)) as mae, var_pop(value) as v from p where prediction is not null group by 1) select series_id, n, round(1 - se / nullif(v * n, 0), 4) as r2, round(sqrt(se / n), 4) as rmse, round(mae, 4) as mae from s")
def g7_regression_metrics(spark, d):
    p = I.daily(spark, d).withColumn("prediction", F.lag("value").over(E.by(["series_id"], ["date"])))
    m = G.regression_metrics(p, ["series_id"], "value", "prediction")
    return m.select("series_id", "n", *(F.round(c, 4).alias(c) for c in ("r2", "rmse", "mae")))


@query("g9_standardise", f"with {I.DAILY} select series_id, date, round((value - avg(value) over (partition by series_id)) / (stddev_pop(value) over (partition by series_id) + 1e-8), 5) as z from daily")
def g9_standardise(spark, d):
    return G.standardise(I.daily(spark, d), ["series_id"], {"value": "z"}).select("series_id", "date", F.round("z", 5).alias("z"))


@query("g10_profile", f"with {I.USER_DAILY} select series_id, min(date) as first, max(date) as last, count(date) as rows from user_daily group by 1")
def g10_profile(spark, d):
    return G.profile(I.user_daily(spark, d), ["series_id"], "date")


@query("g11_top_by_priority", f"with {I.USER_DAILY}, p as (select series_id, date, case when value > 30 then 0 when value > 15 then 1 else 2 end as priority from user_daily) select * from (select *, row_number() over (partition by series_id order by priority, date) as position from p) where position <= 3")
def g11_top_by_priority(spark, d):
    p = I.user_daily(spark, d).select("series_id", "date", F.when(F.col("value") > 30, 0).when(F.col("value") > 15, 1).otherwise(2).alias("priority"))
    return G.top_by_priority(p, ["series_id"], "priority", "date")


@query("slice_rolling_band_histogram", f"with {I.DAILY}, r as (select series_id, value / nullif(avg(value) {rows(6)}, 0) - 0.7 as ratio from daily), b as (select series_id, {BAND.format('ratio')} as band from r where ratio is not null), n as (select series_id, band, count(*) as days from b group by all) select *, round(100 * days / sum(days) over (partition by series_id), 1) as pct from n")
def slice_rolling_band_histogram(spark, d):
    """Scan, aggregate, window, scalar, aggregate: a ratio to the rolling mean, in bands."""
    w = E.by(["series_id"], ["date"])
    r = I.daily(spark, d).withColumn("ratio", S.ratio("value", E.rolling_mean("value", w, 7)) - 0.7)
    return G.band_shares(r, ["series_id"], "ratio")


