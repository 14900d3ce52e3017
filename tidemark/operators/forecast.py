"""Forecasts of keyed series by several experts, blended with weights that only past errors decide.

A frame of experts is long: keys, origin_date, horizon, target_date, expert, prediction. What was known at an origin comes from running
windows over errors in the order in which their truth arrived; no join compares every origin with every error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import by

LEAST_COVERAGE, LEAST_ERRORS, LEAST_ROWS, LEAST_SPAN = 0.90, 20, 20, 19
OBSERVED_ORDER = ("B10", "M2", "RIDGE", "M1F", "B11")
UNOBSERVED_ORDER = ("B11", "RIDGE", "M1F")


def kernel(k: float) -> list[float]:
    """exp(-k * lag) until it falls to a thousandth."""
    return [math.exp(-k * lag) for lag in range(math.ceil(-math.log(0.001) / k) + 1)]


def kinetic_state(df: DataFrame, keys: Sequence[str], date: str, load: str, k: float) -> DataFrame:
    """state and coverage of a first-order response to load; df has a row for each day. state is null below the least coverage."""
    w = kernel(k)
    weights = F.array(*(F.lit(x) for x in w))
    past = by(keys, [date]).rowsBetween(-(len(w) - 1), 0)
    held = F.reverse(F.collect_list(F.struct(F.col(load).cast("double").alias("x"))).over(past))
    df = df.withColumn("_h", held)
    seen = F.zip_with(F.slice(weights, 1, F.size("_h")), "_h", lambda a, h: F.when(h["x"].isNotNull(), a).otherwise(0.0))
    parts = F.zip_with(F.slice(weights, 1, F.size("_h")), "_h", lambda a, h: F.coalesce(a * h["x"], F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    df = df.withColumns({"_w": total(seen), "_s": total(parts)}).withColumn("coverage", F.col("_w") / sum(w))
    return df.withColumn("state", F.when(F.col("coverage") >= LEAST_COVERAGE, F.try_divide("_s", "_w"))).drop("_h", "_w", "_s")


def horizons(df: DataFrame, date: str, most: int = 7) -> DataFrame:
    """Each row for horizons 1 to most, with its target_date."""
    out = df.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long"))))
    return out.withColumnRenamed(date, "origin_date").withColumn("target_date", F.date_add("origin_date", F.col("horizon").cast("int")))


def observed_ahead(df: DataFrame, keys: Sequence[str], date: str, y: str, most: int = 7, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """df, which has a row for each day, at each horizon, with y_true: the value that the target day turned out to have.

    keep: what is done with the days before they are multiplied by the horizons, such as writing them where they are read twice.
    """
    w = by(keys, [date])
    ahead = F.array(*(F.lead(y, h).over(w) for h in range(1, most + 1)))
    df = horizons(keep(df.withColumn("_ahead", ahead)), date, most)
    return df.withColumn("y_true", F.get("_ahead", F.col("horizon").cast("int") - 1)).drop("_ahead")


def fit_experts(rows: DataFrame, keys: Sequence[str], y: str, state: str, features: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """For each of keys and horizon, from one aggregate over training rows with y_true: f0, f1 (the truth on the state), b0, b1 (the day's
    own value on it), and the ridge's intercept and coefficients on the features."""
    own = [*keys, "horizon"]
    lines = [F.regr_intercept("y_true", state).alias("f0"), F.regr_slope("y_true", state).alias("f1"), F.regr_intercept(y, state).alias("b0"), F.regr_slope(y, state).alias("b1")]
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*features, "y_true"]))
    sums = rows.withColumn("_whole", whole).groupBy(*own).agg(*lines, *moments([*features, "y_true"], F.col("_whole")))
    return ridge_fit(sums, own, features, "y_true", penalty, carry=("f0", "f1", "b0", "b1"))


def experts(rows: DataFrame, keys: Sequence[str], y: str, state: str, fits: DataFrame, features: Sequence[str], *, tau: float = 5.0) -> DataFrame:
    """Long experts' predictions for rows of observed_ahead(): B10 the day's value, B11 the last one (columns last and last_date), M1F the
    fit on the state, M2 that with the day's error fading over the horizon, RIDGE the fit on the features. observed tells whether the day
    has a value, age how many days old the last one is; rows without a prediction are left out."""
    df = rows.join(fits, [*keys, "horizon"], "left")
    floor = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    m1f = floor(F.col("f0") + F.col("f1") * F.col(state))
    now = F.col("b0") + F.col("b1") * F.col(state)
    made = {"B10": F.col(y), "B11": F.col("last"), "M1F": m1f, "M2": floor(m1f + (F.col(y) - now) * F.exp(-F.col("horizon") / tau)), "RIDGE": ridge_score(features)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("expert"), c.cast("double").alias("prediction")) for k, c in made.items())))
    out = df.select(*keys, "origin_date", "horizon", "target_date", "y_true", F.col(y).isNotNull().alias("observed"), F.datediff("origin_date", "last_date").cast("long").alias("age"), each.alias("e"))
    out = out.select("*", "e.expert", "e.prediction").drop("e").filter(F.col("prediction").isNotNull())
    return out.withColumn("error", F.col("prediction") - F.col("y_true"))


def past_errors(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """forecasts with n, mse and last_target of the expert's errors whose target_date isn't behind the origin, and truth_var.

    forecasts: keys, horizon, expert, origin_date, target_date, error, y_true (null while the target day isn't known). Each row stands
    twice in one order of days, as an arrival and, behind the day's arrivals, as a question; sums run along it. truth_var is the variance
    of the horizon's truths that had arrived, each once however many experts met it; 1 below two.
    """
    part = [*keys, "horizon", "expert"]
    once = Window.partitionBy(*keys, "horizon", "target_date").orderBy("expert")
    rows = forecasts.withColumn("_first", F.row_number().over(once) == 1)
    came = F.when(F.col("error").isNotNull(), F.struct(F.col("target_date").alias("day"), F.lit(0).alias("kind")))
    asked = F.struct(F.col("origin_date").alias("day"), F.lit(1).alias("kind"))
    rows = rows.withColumn("_e", F.explode(F.array_compact(F.array(came, asked)))).withColumns({"_day": F.col("_e.day"), "_kind": F.col("_e.kind")})
    arrival = F.col("_kind") == 0
    rows = rows.withColumns({"_e2": F.when(arrival, F.col("error") * F.col("error")), "_y": F.when(arrival & F.col("_first"), F.col("y_true")), "_t": F.when(arrival, F.col("target_date"))})
    along = lambda *by: Window.partitionBy(*by).orderBy("_day", "_kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w, all_experts = along(*part), along(*keys, "horizon")
    rows = rows.withColumn("truth_var", F.when(F.count("_y").over(all_experts) >= 2, F.var_pop("_y").over(all_experts)).otherwise(1.0))
    rows = rows.withColumns({"n": F.count("_e2").over(w), "mse": F.avg("_e2").over(w), "last_target": F.max("_t").over(w)})
    return rows.filter("_kind = 1").drop("_first", "_e", "_day", "_kind", "_e2", "_y", "_t")


def weights(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """weight of each expert at each origin and horizon: inverse to the mean square of at least LEAST_ERRORS past errors; where no expert
    has so many, all weight goes to the first of a fixed order that is there. method says which."""
    rows = rows.withColumn("epsilon", F.greatest(F.lit(1e-12), 1e-8 * F.col("truth_var")))
    usable = F.col("observed") | ~F.col("expert").isin("B10", "M2")
    raw = F.when(usable & (F.col("n") >= LEAST_ERRORS), 1 / (F.col("mse") + F.col("epsilon"))).otherwise(0.0)
    rank = lambda order: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, e in enumerate(order) for x in (e, k))), F.col("expert")), F.lit(None).cast("int"))
    place = F.when(F.col("observed"), rank(OBSERVED_ORDER)).otherwise(rank(UNOBSERVED_ORDER))
    one = Window.partitionBy(*keys, "origin_date", "horizon")
    rows = rows.withColumns({"_raw": raw, "_place": F.when(usable, place), "available": usable})
    rows = rows.withColumns({"_sum": F.sum("_raw").over(one), "_first": F.min("_place").over(one)})
    weight = F.when(F.col("_sum") > 0, F.try_divide("_raw", "_sum")).otherwise(F.when(F.col("_place") == F.col("_first"), 1.0).otherwise(0.0))
    return rows.withColumns({"weight": weight, "method": F.when(F.col("_sum") > 0, "INVERSE_ERROR").when(F.col("_first").isNotNull(), "FALLBACK").otherwise("NONE")}).drop("_raw", "_place", "_sum", "_first")


#: What error states hold besides their keys, horizon and expert; the row of all experts, "*", is of the truths.
ERROR_STATE = "n long, s double, mean double, m2 double, through date"
TRUTHS = "*"


def error_sums(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A batch of errors (keys, horizon, expert, target_date, error, y_true) as a state: n and sum of squares for each expert, and n, mean
    and summed squares about it of the truths, each once."""
    none = F.lit(None).cast("double")
    each = errors.groupBy(*keys, "horizon", "expert").agg(F.count("error").alias("n"), F.sum(F.col("error") * F.col("error")).alias("s"), none.alias("mean"), none.alias("m2"), F.max("target_date").alias("through"))
    truths = errors.groupBy(*keys, "horizon", "target_date").agg(F.min("y_true").alias("y"))
    moments = truths.groupBy(*keys, "horizon").agg(F.lit(TRUTHS).alias("expert"), F.count("y").alias("n"), none.alias("s"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("m2"), F.max("target_date").alias("through"))
    return each.unionByName(moments)


def merged_sums(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of several batches, put together in the order of their days; the truths' moments as parts of one sample."""
    part = F.struct("through", "n", "mean", "m2")

    def both(a: Column, b: Column) -> Column:
        n, step = a["n"] + b["n"], b["mean"] - a["mean"]
        joint = F.struct(b["through"].alias("through"), n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"))
        return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(joint)

    parts = F.array_sort(F.collect_list(part))
    out = states.groupBy(*keys, "horizon", "expert").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("through").alias("through"), parts.alias("_parts"))
    first = F.get("_parts", F.lit(0))
    whole = F.aggregate(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), first, both)
    truths = F.col("expert") == TRUTHS
    return out.select(*keys, "horizon", "expert", "n", "s", F.when(truths, whole["mean"]).alias("mean"), F.when(truths, whole["m2"]).alias("m2"), "through")


def advance(table, errors: DataFrame, keys: Sequence[str]) -> None:
    """Adds errors to a StateTable of keys, horizon and expert; those of days that it has already are left out, so a batch may be repeated.

    Experts' sums and the truths' moments change in one version.
    """
    state = table.read(errors.sparkSession)
    seen = state.filter(F.col("expert") == TRUTHS).select(*keys, "horizon", F.col("through").alias("_seen"))
    new = errors.filter(F.col("error").isNotNull()).join(seen, [*keys, "horizon"], "left").filter(F.col("_seen").isNull() | (F.col("target_date") > F.col("_seen"))).drop("_seen")
    sums = error_sums(new, keys)
    touched = state.join(sums.select(*keys, "horizon", "expert"), [*keys, "horizon", "expert"], "left_semi")
    table.upsert(merged_sums(touched.select(*sums.columns).unionByName(sums), keys))


def errors_so_far(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (of origins at the state's last day) with n, mse, last_target and truth_var as past_errors has them, without the history."""
    own = state.filter(F.col("expert") != TRUTHS).select(*keys, "horizon", "expert", "n", (F.col("s") / F.col("n")).alias("mse"), F.col("through").alias("last_target"))
    truths = state.filter(F.col("expert") == TRUTHS).select(*keys, "horizon", F.when(F.col("n") >= 2, F.col("m2") / F.col("n")).otherwise(1.0).alias("truth_var"))
    out = rows.join(own, [*keys, "horizon", "expert"], "left").join(truths, [*keys, "horizon"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "truth_var": F.coalesce("truth_var", F.lit(1.0))})


def blend(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """prediction: the weighted sum, not below zero, with maps of the experts' predictions and weights."""
    used = F.when(F.col("weight") > 0, F.col("weight") * F.col("prediction"))
    out = rows.groupBy(*keys, "origin_date", "horizon", "target_date").agg(
        F.sum(used).alias("_p"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("expert", "prediction")))).alias("expert_predictions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("expert", "weight")))).alias("weights"),
    )
    return out.withColumn("prediction", F.when(F.col("_p").isNotNull(), F.greatest(F.lit(0.0), F.col("_p")))).drop("_p")


def audit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What stands behind each forecast: experts, a map from expert to its prediction, availability, weight and error statistics; whether
    the origin day was observed, the last observation's age, epsilon and the method of the weights."""
    own = F.struct("expert", F.struct("prediction", "available", "weight", "n", "mse", "last_target").alias("about"))
    whole = [F.first(c).alias(c) for c in ("observed", "age", "epsilon", "method")]
    return rows.groupBy(*keys, "origin_date", "horizon", "target_date").agg(F.map_from_entries(F.array_sort(F.collect_list(own))).alias("experts"), *whole)


def experts_at(made: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, origin_date and have: the targets and horizons (`methane:h1`) for which an expert that may be asked gives a prediction."""
    asked = F.col("prediction").isNotNull() & (F.col("observed") | ~F.col("expert").isin("B10", "M2"))
    name = F.concat("target", F.lit(":h"), F.col("horizon").cast("string"))
    return made.groupBy(*keys, "origin_date").agg(F.collect_set(F.when(asked, name)).alias("have"))


def origins(df: DataFrame, keys: Sequence[str], date: str, features: Sequence[str], has_expert: Column | None = None, *, required: Sequence[tuple[str, int]] = (), have: str = "have") -> DataFrame:
    """Each row as a candidate origin: ok, and reasons why not (array). One pass of running windows.

    Experts are asked for each required target and horizon, by the names in the column ``have`` (see experts_at), and only where the rows
    so far and the features are sufficient: `NO_EXPERT:target:h1`. has_expert tells for all of them at once.
    """
    w = by(keys, [date]).rowsBetween(Window.unboundedPreceding, 0)
    rows, span = F.count(F.lit(1)).over(w), F.datediff(F.col(date), F.min(date).over(w))
    whole = F.array_compact(F.array(*features))
    checks = [
        F.when(rows < LEAST_ROWS, "INSUFFICIENT_ROWS"),
        F.when((rows >= LEAST_ROWS) & (span < LEAST_SPAN), "INSUFFICIENT_SPAN"),
        F.when(F.size(whole) < len(features), "NON_FINITE_FEATURE"),
    ]
    if has_expert is not None:
        checks.append(F.when(~F.coalesce(has_expert, F.lit(False)), "NO_EXPERT"))
    reasons = F.array_compact(F.array(*checks))
    out = df.withColumn("_reasons", reasons)
    if required:
        names = F.array(*(F.lit(f"{t}:h{h}") for t, h in required))
        missing = F.transform(F.array_except(names, F.coalesce(F.col(have), F.array().cast("array<string>"))), lambda r: F.concat(F.lit("NO_EXPERT:"), r))
        out = out.withColumn("_reasons", F.when(F.size("_reasons") == 0, missing).otherwise(F.col("_reasons")))
    return out.select(*keys, F.col(date).alias("origin_date"), F.col("_reasons").alias("reasons")).withColumn("ok", F.size("reasons") == 0)


def latest_origin(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("origin_date"))).alias("origin_date"))


def rejected(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates behind the latest good one, with their reasons, and the class of the error where there is none."""
    last = latest_origin(candidates, keys).withColumnRenamed("origin_date", "_last")
    out = candidates.join(last, list(keys)).filter(F.col("_last").isNull() | (F.col("origin_date") > F.col("_last")))
    short = F.exists("reasons", lambda r: r.startswith("INSUFFICIENT"))
    return out.withColumn("error", F.when(F.col("_last").isNull(), F.when(short, "INSUFFICIENT_HISTORY").otherwise("NO_FORECASTABLE_ORIGIN"))).drop("_last", "ok")


def unavailable(candidates: DataFrame, keys: Sequence[str], most: int = 10) -> DataFrame:
    """For each of keys without a good origin: status (why), reason (its newest rejected days with their reasons), and no predictions."""
    w = Window.partitionBy(*keys)
    rows = candidates.withColumns({"_rows": F.count(F.lit(1)).over(w), "_ok": F.max(F.col("ok").cast("int")).over(w), "_n": F.row_number().over(w.orderBy(F.desc("origin_date")))})
    rows = rows.filter((F.col("_ok") == 0) & (F.col("_n") <= most))
    told = F.transform(F.array_sort(F.collect_list(F.struct("_n", "origin_date", "reasons"))), lambda r: F.concat(r["origin_date"].cast("string"), F.lit(": "), F.array_join(r["reasons"], ",")))
    out = rows.groupBy(*keys).agg(F.when(F.max("_rows") < LEAST_ROWS, "INSUFFICIENT_HISTORY").otherwise("NO_FORECASTABLE_ORIGIN").alias("status"), F.array_join(told, "; ").alias("reason"))
    return out.withColumns({"origin_date": F.lit(None).cast("date"), "predictions": F.array().cast("array<struct<horizon:int,target_date:date,value:double>>")})


def with_unavailable(wanted: DataFrame, forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each wanted (keys, origin_date, horizon), available or not."""
    out = wanted.join(forecasts, [*keys, "origin_date", "horizon"], "left")
    return out.withColumn("status", F.when(F.col("prediction").isNotNull(), "AVAILABLE").otherwise("UNAVAILABLE"))


def latest_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of stored runs the last of each of keys, by created_at and run_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def complete(forecasts: DataFrame, keys: Sequence[str], most: int = 7) -> DataFrame:
    """complete: an origin has each horizon from 1 to most once, all with a prediction."""
    out = forecasts.groupBy(*keys, "origin_date").agg(F.array_sort(F.collect_list("horizon")).alias("_h"), F.bool_and(F.col("prediction").isNotNull()).alias("_p"))
    return out.withColumn("complete", F.col("_p") & (F.col("_h") == F.sequence(F.lit(1), F.lit(most)).cast("array<bigint>"))).drop("_h", "_p")


def headline(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """last_actual, day1, day7, change: the summary of one origin's forecasts. actuals: keys, origin_date, last_actual."""
    out = forecasts.groupBy(*keys, "origin_date").agg(F.max(F.when(F.col("horizon") == 1, F.col("prediction"))).alias("day1"), F.max(F.when(F.col("horizon") == 7, F.col("prediction"))).alias("day7"))
    return out.join(actuals, [*keys, "origin_date"], "left").withColumn("change", F.col("day7") - F.col("last_actual"))


def bridge(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The segment that joins an origin's last observed value to its first forecast: from_date, from_value, to_date, to_value.

    actuals: keys, origin_date, last_date, last_actual. Origins without either end have none.
    """
    first = forecasts.filter((F.col("horizon") == 1) & F.col("prediction").isNotNull())
    out = first.join(actuals.filter(F.col("last_actual").isNotNull()), [*keys, "origin_date"])
    return out.select(*keys, "origin_date", F.col("last_date").alias("from_date"), F.col("last_actual").alias("from_value"), F.col("target_date").alias("to_date"), F.col("prediction").alias("to_value"))


def moments(names: Sequence[str], where: Column) -> list[Column]:
    """n, the sums of the columns, and of their products, over rows where the condition holds."""
    own = lambda x: F.sum(F.when(where, x))
    return [F.count(F.when(where, 1)).alias("n"), *(own(F.col(a)).alias(f"s_{a}") for a in names), *(own(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:])]


def ridge_sums(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """n, the sums of features and y, and of their products, over rows that have all."""
    names = [*features, y]
    return df.dropna(subset=names).groupBy(*keys).agg(*moments(names, F.lit(True)))


def ridge_fit(sums: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, penalty: float = 1.0, carry: Sequence[str] = ()) -> DataFrame:
    """intercept and coefficients (array) from ridge_sums(), null without rows: the small systems of a batch are solved at once."""
    names, k = [*features, y], len(features)
    kept = [*keys, *carry]
    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in kept)

    def solve(batches):
        for b in batches:
            n = b["n"].to_numpy(float)
            some = n > 0
            one = np.where(some, n, 1.0)
            mean = np.nan_to_num(b[[f"s_{a}" for a in names]].to_numpy(float)) / one[:, None]
            m = np.array([[np.nan_to_num(b[f"s_{names[min(i, j)]}_{names[max(i, j)]}"].to_numpy(float)) for j in range(k + 1)] for i in range(k + 1)]).transpose(2, 0, 1)
            m = m - one[:, None, None] * mean[:, :, None] * mean[:, None, :]
            c = np.linalg.solve(m[:, :k, :k] + penalty * np.eye(k), m[:, :k, k:])[:, :, 0] if len(b) else np.zeros((0, k))
            intercept = mean[:, k] - (c * mean[:, :k]).sum(axis=1)
            yield b[kept].assign(intercept=np.where(some, intercept, np.nan), coefficients=[x.tolist() if ok else None for x, ok in zip(c, some)])

    out = sums.mapInPandas(solve, f"{kinds}, intercept double, coefficients array<double>")
    return out.withColumn("intercept", F.nanvl("intercept", F.lit(None).cast("double")))


def ridge_score(features: Sequence[str]) -> Column:
    """Prediction from the columns and the joined intercept and coefficients."""
    out = F.col("intercept")
    for i, f in enumerate(features):
        out = out + F.get("coefficients", F.lit(i)) * F.col(f)
    return F.when(out.isNotNull(), F.greatest(F.lit(0.0), out))
