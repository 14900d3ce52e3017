"""Training and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, ratio_band
from tidemark.operators import learning as L
from tidemark.operators import series as E
from tidemark.operators import stacking as K
from tidemark.operators import stats as G
from tidemark.plans import inputs as I
from tidemark.plans.registry import query

HOLDOUT = 1998
BY = "over (partition by series_id order by date)"
ROWS = f"""{I.ORDER_DAILY}, rows_ as (select series_id, date, x, y, lag(y, 1) {BY} as p1, lag(y, 7) {BY} as p7, avg(y) over (partition by series_id order by date rows between 7 preceding and 1 preceding) as pm from order_daily),
train as (select * from rows_ where year(date) < {HOLDOUT}), holdout as (select * from rows_ where year(date) = {HOLDOUT})"""
MODELS = ["p1", "p7", "pm"]


def rows(spark, d):
    """A target with three naive base predictions."""
    w = E.by(["series_id"], ["date"])
    return I.order_daily(spark, d).withColumns({"p1": F.lag("y", 1).over(w), "p7": F.lag("y", 7).over(w), "pm": F.avg("y").over(w.rowsBetween(-7, -1))})


@query("j1_year_split", f"with {ROWS} select series_id, date, 'train' as part from train union all select series_id, date, 'holdout' from holdout")
def j1_year_split(spark, d):
    train, holdout = L.year_split(rows(spark, d), "date", HOLDOUT)
    return train.select("series_id", "date", F.lit("train").alias("part")).unionByName(holdout.select("series_id", "date", F.lit("holdout").alias("part")))


@query("j2_meta_split", f"with {ROWS} select series_id, date, case when year(date) > {HOLDOUT - 3} then 'meta' else 'early' end as block from train")
def j2_meta_split(spark, d):
    return L.meta_split(L.year_split(rows(spark, d), "date", HOLDOUT)[0], "date").select("series_id", "date", "block")


@query("j3_tail_split", f"with {ROWS} select series_id, date, row_number() {BY} > count(*) over (partition by series_id) - greatest(1, floor(count(*) over (partition by series_id) * 0.15)) as tail from train")
def j3_tail_split(spark, d):
    return L.tail_split(L.year_split(rows(spark, d), "date", HOLDOUT)[0], ["series_id"], ["date"]).select("series_id", "date", "tail")


@query("j4_j5_random_forest")
def j4_j5_random_forest(spark, d):
    """A forest fitted on the early block for the meta block, and on all training rows for the holdout."""
    train, holdout = L.year_split(rows(spark, d), "date", HOLDOUT)
    blocks = L.meta_split(train, "date")
    phases = [("meta", blocks.filter("block = 'early'"), blocks.filter("block = 'meta'")), ("holdout", train, holdout)]
    made = [L.forest_predictions(a, b, MODELS, "y", "prediction").select("series_id", "date", F.lit(k).alias("phase"), F.round("prediction", 4).alias("prediction"), "y") for k, a, b in phases]
    return made[0].unionByName(made[1])


_PRODUCTS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i:]]


@query("j6_gram_sums", f"with {ROWS} select series_id, count(*) as n, {', '.join(f'round(sum({a} * {b}) / 1e6, 4) as {a}__{b}' for a, b in _PRODUCTS)}, {', '.join(f'round(sum({a} * y) / 1e6, 4) as {a}__y' for a in MODELS)} from train where p7 is not null group by 1")
def j6_gram_sums(spark, d):
    g = L.gram(L.year_split(rows(spark, d), "date", HOLDOUT)[0], ["series_id"], MODELS, "y")
    return g.select("series_id", "n", *(F.round(F.col(c) / 1e6, 4).alias(c) for c in g.columns if "__" in c))


def _weights_sql(source: str, keys: list[str], least: int = 1) -> str:
    """Weights for each of keys by trying each support of the three models: determinants of the support's sums, and the least loss of those without a negative one."""
    k, own = "".join(f"{c}, " for c in keys), f"partition by {', '.join(keys)} " if keys else ""
    group, using = (f"group by {', '.join(keys)} having count(*) >= {least}", f"join s using ({', '.join(keys)})") if keys else ("", ", s")
    g = {(a, b): f"g{min(i, j)}{max(i, j)}" for i, a in enumerate(MODELS) for j, b in enumerate(MODELS)}
    sums = ", ".join([f"sum({MODELS[i]} * {MODELS[j]}) as g{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum({m} * y) as y{i}" for i, m in enumerate(MODELS)])
    at = lambda i, j: g[MODELS[i], MODELS[j]]
    tries = [f"select {k}{', '.join(f'y{i} / {at(i, i)}' if m == i else '0.0' for m in range(3))} from s" for i in range(3)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        det = f"({at(i, i)} * {at(j, j)} - {at(i, j)} * {at(i, j)})"
        w = {i: f"(y{i} * {at(j, j)} - y{j} * {at(i, j)}) / {det}", j: f"(y{j} * {at(i, i)} - y{i} * {at(i, j)}) / {det}"}
        tries.append(f"select {k}{', '.join(w.get(m, '0.0') for m in range(3))} from s")
    det3 = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    whole = [[at(i, j) for j in range(3)] for i in range(3)]
    part = lambda c: [[f"y{i}" if j == c else whole[i][j] for j in range(3)] for i in range(3)]
    tries.append(f"select {k}{', '.join(f'{det3(part(c))} / {det3(whole)}' for c in range(3))} from s")
    loss = " + ".join(f"w{i} * w{j} * {at(i, j)}" for i in range(3) for j in range(3)) + " - 2 * (" + " + ".join(f"w{i} * y{i}" for i in range(3)) + ")"
    return f"""s as (select {k}{sums} from {source} where p1 is not null and p7 is not null and pm is not null and y is not null {group}),
tried({k}w0, w1, w2) as (select {k}0.0, 0.0, 0.0 from s union all {' union all '.join(tries)}),
stack as (select {k}w0, w1, w2 from tried {using} where w0 >= 0 and w1 >= 0 and w2 >= 0 and isfinite(w0 + w1 + w2)
  qualify row_number() over ({own}order by {loss}) = 1)"""


META = f"meta as (select * from train where year(date) > {HOLDOUT - 3})"
STACK = META + ", " + _weights_sql("meta", [])


def stack(spark, d):
    """Weights of the meta block over all series."""
    meta = L.meta_split(L.year_split(rows(spark, d), "date", HOLDOUT)[0], "date").filter("block = 'meta'")
    return K.stacking_weights(meta, [], {"y": "y"}, {"y": MODELS})


def stacked_holdout(spark, d):
    """Held-out rows with the stack's prediction."""
    return K.stacked(L.year_split(rows(spark, d), "date", HOLDOUT)[1], [], stack(spark, d), {"y": MODELS}, {"y": "stacked"})


@query("j6_weights", f"with {ROWS}, {STACK} select unnest(['p1', 'p7', 'pm']) as model, unnest([round(w0, 6), round(w1, 6), round(w2, 6)]) as weight from stack")
def j6_weights(spark, d):
    """The stack's weights, least squares without negative ones, over all series of the meta block."""
    return K.weight_rows(stack(spark, d), [], MODELS).select("model", F.round("weight", 6).alias("weight"))


@query("j6_j7_stacked_predictions", f"with {ROWS}, {STACK} select series_id, date, round(w0 * p1 + w1 * p7 + w2 * pm, 3) as prediction, y from holdout, stack")
def j6_j7_stacked_predictions(spark, d):
    return stacked_holdout(spark, d).select("series_id", "date", F.round("stacked", 3).alias("prediction"), "y")


#: Rows that a customer's weights need.
LEAST = 5
VISITS = """visits as (select o_custkey, o_orderkey, cast(o_orderdate as date) as date, o_totalprice / 1000.371 as price,
  cast(date_diff('day', lag(cast(o_orderdate as date)) over w, cast(o_orderdate as date)) as double) as gap from orders window w as (partition by o_custkey order by cast(o_orderdate as date), o_orderkey)),
long as (select o_custkey, o_orderkey, date, unnest(['gap', 'price']) as target, unnest([gap, price]) as y from visits),
lags as (select *, lag(y) over w as p1, lag(y, 2) over w as p7, avg(y) over (w rows between unbounded preceding and 1 preceding) as pm,
  row_number() over w > count(*) over (partition by o_custkey, target) - greatest(1, floor(count(*) over (partition by o_custkey, target) * 0.15)) as tail from long window w as (partition by o_custkey, target order by date, o_orderkey)),
fit as (select * from lags where not tail)"""
VISITORS = VISITS + ", " + _weights_sql("fit", ["o_custkey", "target"], LEAST)
TRUTHS = {"gap": "gap", "price": "price"}
NAIVE = {t: [f"{t}_1", f"{t}_2", f"{t}_mean"] for t in TRUTHS}


def visits(spark, d):
    """Orders of customers with two targets, the price and the days since the order before, and three naive predictions of each."""
    o = I.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1000.371).alias("price"))
    w = E.by(["o_custkey"], ["date", "o_orderkey"])
    o = o.withColumn("gap", F.datediff("date", F.lag("date").over(w)).cast("double"))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    o = o.withColumns({f"{t}_1": F.lag(t).over(w) for t in TRUTHS} | {f"{t}_2": F.lag(t, 2).over(w) for t in TRUTHS} | {f"{t}_mean": F.avg(t).over(past) for t in TRUTHS})
    return L.tail_split(o, ["o_custkey"], ["date", "o_orderkey"])


def visitor_weights(spark, d):
    return K.stacking_weights(visits(spark, d).filter("not tail"), ["o_custkey"], TRUTHS, NAIVE, least=LEAST)


@query("j6_weights_by_key", f"with {VISITORS} select o_custkey, target, unnest(['last', 'second', 'mean']) as model, unnest([round(w0, 4), round(w1, 4), round(w2, 4)]) as weight from stack")
def j6_weights_by_key(spark, d):
    """J6 for each customer and each of two targets."""
    return K.weight_rows(visitor_weights(spark, d), ["o_custkey"], ["last", "second", "mean"]).withColumn("weight", F.round("weight", 4))


@query(
    "j6_j7_predictions_by_key",
    f"""with {VISITORS}, t as (select o_custkey, o_orderkey, target, round(w0 * p1 + w1 * p7 + w2 * pm, 3) as p from lags left join stack using (o_custkey, target) where tail)
select o_custkey, o_orderkey, max(case when target = 'gap' then p end) as gap_stacked, max(case when target = 'price' then p end) as price_stacked from t group by all""",
)
def j6_j7_predictions_by_key(spark, d):
    """Each customer's last orders, predicted by its own weights of both targets."""
    out = K.stacked(visits(spark, d).filter("tail"), ["o_custkey"], visitor_weights(spark, d), NAIVE, {t: f"{t}_stacked" for t in TRUTHS})
    return out.select("o_custkey", "o_orderkey", *(F.round(f"{t}_stacked", 3).alias(f"{t}_stacked") for t in TRUTHS))


@query("j9_prediction_table", f"with {ROWS}, {STACK} select series_id, date, y as true, round(w0 * p1 + w1 * p7 + w2 * pm, 3) as predicted, x, round(y / x, 6) as yield from holdout, stack where y is not null and p1 is not null and p7 is not null and pm is not null")
def j9_prediction_table(spark, d):
    """Truth, the stack's prediction and diagnostics (load and yield) of each held-out row."""
    holdout = stacked_holdout(spark, d).withColumn("yield", F.round(ratio("y", "x"), 6))
    return L.prediction_table(holdout, ["series_id", "date"], "y", F.round("stacked", 3), ["x", "yield"])


@query("j7_combine", f"with {ROWS} select series_id, date, round(0.5 * p1 + 0.25 * p7 + 0.25 * pm, 6) as prediction from holdout")
def j7_combine(spark, d):
    holdout = L.year_split(rows(spark, d), "date", HOLDOUT)[1]
    return holdout.select("series_id", "date", F.round(L.combine({"p1": 0.5, "p7": 0.25, "pm": 0.25}), 6).alias("prediction"))


@query("j8_normalise", f"with {I.DAILY} select series_id, date, round(n / sum(n) over (partition by series_id), 4) as share from daily")
def j8_normalise(spark, d):
    return L.normalise(I.daily(spark, d), ["series_id"], "n").select("series_id", "date", "share")


@query("j9_model_table", f"with {ROWS}, u as (unpivot (select y, p1, p7, pm from holdout) on p1, p7, pm into name model value prediction), s as (select model, count(*) as n, sum((prediction - y) ** 2) as se, avg(abs(prediction - y)) as mae, var_pop(y) as v from u where prediction is not null group by 1) select model, n, round(1 - se / nullif(v * n, 0), 4) as r2, round(sqrt(se / n), 3) as rmse, round(mae, 3) as mae from s")
def j9_model_table(spark, d):
    t = L.model_table(L.year_split(rows(spark, d), "date", HOLDOUT)[1], MODELS, "y")
    return t.select("model", "n", F.round("r2", 4).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query("j10_holdout_bands", f"with {I.PANEL}, b as (select series_id, case when VFA_TA_A < 0.30 then 'Stable' when VFA_TA_A < 0.40 then 'Caution' when VFA_TA_A < 0.80 then 'Unstable' else 'Danger' end as class from panel where VFA_TA_A is not null and year(date) = {HOLDOUT}), s as (select distinct series_id from panel where year(date) = {HOLDOUT}), c as (select unnest(['Stable', 'Caution', 'Unstable', 'Danger']) as class, unnest(cast([0, 1, 2, 3] as bigint[])) as position), n as (select series_id, class, count(*) as n from b group by all) select series_id, class, position, coalesce(n, 0) as n from s cross join c left join n using (series_id, class)")
def j10_holdout_bands(spark, d):
    holdout = L.year_split(I.panel(spark, d), "date", HOLDOUT)[1]
    return G.class_counts(holdout, ["series_id"], ratio_band("VFA_TA_A"))
