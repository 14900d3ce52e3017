"""Rule scenarios as rows in, rows out, pinned constants, and a loop form of the history grades."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import forecast, health, learning, quality

BASE = {"temperature": (38.5, 38.6), "pH": (7.9, 7.92), "VFA": (2900.0, 2950.0), "ALK": (17000.0, 17200.0), "VFA_TA": (0.17, 0.17), "TAN": (4000.0, 4050.0), "FAN": (400.0, 420.0), "TS": (2.6, 2.6), "VS": (1.1, 1.1), "CODcr": (25000.0, 25000.0)}


def diagnose(spark, *days, extra=None):
    """days: changes from BASE, one row each; extra: further columns of the last row."""
    rows = []
    for i, change in enumerate(days):
        values = BASE | change
        row = {"k": "x", "date": f"2024-01-{i + 1:02d}"} | {f"{v}_{s}": values[v][j] for v in values for j, s in enumerate("AB")}
        rows.append(row | {c: None for c in (extra or {})} if i < len(days) - 1 else row | (extra or {}))
    schema = "k string, date string, " + ", ".join(f"{c} {'string' if c.endswith('_dq') else 'double'}" for c in rows[0] if c not in ("k", "date"))
    df = spark.createDataFrame([tuple(r[c] for c in rows[0]) for r in rows], schema).withColumn("date", F.to_date("date"))
    if extra:
        df = df.withColumns({c: F.coalesce(c, F.lit("VALID")) for c in extra if c.endswith("_dq")})
    return health.diagnose(df, ["k"], "date").orderBy("date").collect()


def codes(row):
    return [f["code"] for f in row["flags"]]


def test_normal(spark):
    r = diagnose(spark, {})[0]
    assert (r["state"], r["confidence"], r["lamp"]) == ("NORMAL", "HIGH", "GREEN")


@pytest.mark.parametrize(
    ("change", "state", "code", "feed"),
    [
        ({"VFA": (3700.0, 3000.0)}, "DATA_SUSPECT", "VFA_ONE_SIDED_RISK_RED", None),
        ({"VFA_TA": (0.23, 0.24)}, "PROCESS_WATCH", "ACID_WATCH", None),
        ({"VFA_TA": (0.50, 0.52)}, "PROCESS_ACTION", "ACID_SEVERE", 99.0),
        ({"temperature": (None, 38.5)}, "DATA_SUSPECT", "THERMAL_ONE_SIDED_INVALID", None),
        ({"temperature": (35.0, 35.5)}, "PROCESS_ACTION", "THERMAL_ACTION_CANDIDATE", None),
        ({"temperature": (35.0, 38.5)}, "DATA_SUSPECT", "THERMAL_ONE_SIDED_ABNORMAL", None),
    ],
)
def test_scenarios(spark, change, state, code, feed):
    r = diagnose(spark, change)[0]
    assert (r["state"], r["code"], r["feed_target"]) == (state, code, feed)
    assert r["thermal_gate"] == ("CONDITION_VERIFIED" if code == "THERMAL_ACTION_CANDIDATE" else "CONDITION_NOT_VERIFIED")


def test_early_acid_needs_a_rise_on_both_sides(spark):
    before = {"VFA_TA": (0.20, 0.195), "VFA": (2150.0, 2230.0)}
    now = {"VFA_TA": (0.25, 0.24), "VFA": (2900.0, 2950.0)}
    r = diagnose(spark, before, now)[1]
    assert (r["state"], r["code"], r["feed_target"]) == ("PROCESS_ACTION", "ACID_EARLY", 135.0)
    assert diagnose(spark, now)[0]["code"] == "ACID_WATCH"


def test_old_tan_withholds_fan(spark):
    r = diagnose(spark, {}, extra={"TAN_A_age": 20.0, "TAN_B_age": 20.0})[0]
    assert (r["FAN_A_reason"], r["FAN_B_reason"], r["state"]) == ("UNAVAILABLE_STALE_TAN", "UNAVAILABLE_STALE_TAN", "NORMAL_DEGRADED_DATA")


def test_low_alkalinity_alone_opens_no_gate(spark):
    assert diagnose(spark, {"ALK": (14000.0, 14200.0)})[0]["alkali_gate"] == "CONDITION_NOT_VERIFIED"


def test_suspects_are_used_and_invalid_cells_are_not(spark):
    r = diagnose(spark, {}, extra={"CODcr_A_dq": "INVALID_RANGE", "pH_A_dq": "SUSPECT_SPIKE"})[0]
    assert (r["CODcr_A_band"], r["pH_A_band"], r["pH_A_suspect"], r["state"]) == ("DATA", "GREEN", True, "NORMAL_DEGRADED_DATA")


def test_sequence_of_states(spark):
    watch, action = {"VFA_TA": (0.23, 0.24)}, {"VFA_TA": (0.50, 0.52)}
    assert [r["state"] for r in diagnose(spark, watch, action, watch, {})] == ["PROCESS_WATCH", "PROCESS_ACTION", "PROCESS_WATCH", "RECOVERY"]


def test_constants():
    assert (dims.ACID_WATCH, dims.ACID_P95, dims.ACID_SEVERE, dims.TAN_MAX_AGE) == (0.215, 0.207, 0.45, 14)
    assert round(dims.FEED_REFERENCE * dims.FEED_EARLY, 1) == 135.0 and round(dims.FEED_REFERENCE * dims.FEED_SEVERE, 1) == 99.0
    assert len(dims.BANDS) == 10 and dims.BANDS["pH"][:4] == (7.56, 7.70, 8.14, 8.21)


def by_loop(cells):
    """Grades one series' cells (value or None), by looping."""
    out, values, deltas = [], [], []
    for i, v in enumerate(cells):
        if v is None:
            out.append("MISSING")
            continue
        far = lambda x, h: len(h) >= 7 and (m := statistics.median(h), d := statistics.median(abs(y - m) for y in h))[1] > 0 and abs(x - m) > 3 * 1.4826 * d
        status = "SUSPECT_TEMPORAL_OUTLIER" if far(v, values[-15:]) else "VALID"
        if i and cells[i - 1] is not None:
            if far(v - cells[i - 1], deltas[-15:]):
                status = "SUSPECT_SPIKE"
            deltas.append(v - cells[i - 1])
        values.append(v)
        out.append(status)
    start = 0
    for i in range(1, len(cells) + 1):
        if i == len(cells) or cells[i] is None or cells[i] != cells[i - 1]:
            if i - start >= 7 and cells[start] is not None:
                out[start:i] = ["SUSPECT_FLATLINE" if s == "VALID" else s for s in out[start:i]]
            start = i
    return out


def test_history_grades_equal_the_loop(spark):
    rng = random.Random(3)
    series = {}
    for k in range(40):
        series[f"s{k}"] = [None if (u := rng.random()) < 0.12 else 7.0 if 20 <= i < 30 else round(rng.gauss(50, 3) * (3 if u > 0.97 else 1), 2) for i in range(60)]
    rows = [(k, i, None if v is None else repr(v), 0.0, None, False, True) for k, vs in series.items() for i, v in enumerate(vs)]
    cells = spark.createDataFrame(rows, "series_id string, i int, raw_value string, minimum double, maximum double, zero_missing boolean, flatline boolean")
    got = quality.grade_history(quality.classify_cells(cells), ["series_id"], ["i"]).select("series_id", "i", "status").collect()
    found = {(r["series_id"], r["i"]): r["status"] for r in got}
    want = {(k, i): s for k, vs in series.items() for i, s in enumerate(by_loop(vs))}
    assert found == want
    assert {"SUSPECT_SPIKE", "SUSPECT_TEMPORAL_OUTLIER", "SUSPECT_FLATLINE"} <= set(want.values())


def test_cell_classes(spark):
    raw = ["", None, "nan", "bad", "inf", "0", "-1", "5", "150", " 7.5 ", "1_000", "1e2"]
    cells = spark.createDataFrame([(i, r, 0.0, 100.0, True) for i, r in enumerate(raw)], "i int, raw_value string, minimum double, maximum double, zero_missing boolean")
    got = [r["status"] for r in quality.classify_cells(cells).orderBy("i").collect()]
    assert got == ["MISSING", "MISSING", "INVALID_PARSE", "INVALID_PARSE", "INVALID_PARSE", "MISSING_ZERO_SENTINEL", "INVALID_RANGE", "VALID", "INVALID_RANGE", "VALID", "INVALID_PARSE", "VALID"]


def test_medians_of_histories_are_taken_in_batches(spark):
    """Each history is sorted once, outside the row's expressions; short, null and spreadless ones flag nothing."""
    import pyarrow as pa

    cells = spark.createDataFrame([("s", i, str(10 + i % 5)) for i in range(20)], "series_id string, i int, raw_value string")
    cells = cells.selectExpr("*", "0d minimum", "cast(null as double) maximum", "true zero_missing", "true flatline")
    plan = quality.grade_history(quality.classify_cells(cells), ["series_id"], ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "ArrowEvalPython" in plan
    rng = random.Random(3)
    histories = [[rng.choice([1.0, 2.0, 3.5, -4.0, 1e6]) for _ in range(rng.randint(0, 15))] for _ in range(300)] + [None, [1.0] * 9, [1e308, -1e308] * 5]
    values = [rng.choice([2.0, 30.0, -1e7, None]) for _ in histories]

    def plain(x, h):
        if x is None or not h or len(h) < 7:
            return False
        m = statistics.median(h)
        d = statistics.median(abs(v - m) for v in h)
        return d > 0 and abs(x - m) > 3 * 1.4826 * d

    got = quality._robust(pa.array(values, pa.float64()), pa.array(histories, pa.list_(pa.float64()))).to_pylist()
    assert got == [plain(x, h) for x, h in zip(values, histories)] and True in got
    assert quality._robust(pa.array([], pa.float64()), pa.array([], pa.list_(pa.float64()))).to_pylist() == []


def test_flagged_makes_its_cells_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def status(i):
        made.add(1)
        return "MISSING" if i % 3 else "VALID"

    cells = spark.range(60).withColumn("status", status.asNondeterministic()("id"))
    got = quality.flagged(cells, ["id"], most=5).collect()
    assert [(r["id"], r["total"]) for r in got] == [(i, 40) for i in (1, 2, 4, 5, 7)] and made.value == 60


def test_weights_sum_to_one(spark, sf):
    from tidemark.plans.forecast_plans import weighted

    sums = weighted(spark, sf).groupBy("series_id", "target", "origin_date", "horizon").agg(F.sum("weight").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9


def test_kernel_and_nonnegative_weights():
    assert forecast.kernel(0.35)[0] == 1.0 and len(forecast.kernel(0.35)) == 21
    sums = {"a__a": 10.0, "a__b": 0.0, "b__b": 10.0, "a__y": 5.0, "b__y": -3.0}
    assert learning.nonnegative_weights(sums, ["a", "b"]) == [0.5, 0.0]


def test_forest_of_the_query_has_all_trees_at_full_depth(spark, sf, monkeypatch):
    from pyspark.ml import regression

    from tidemark.plans.learning_plans import j4_j5_random_forest

    class Asked(Exception):
        pass

    def forest(**options):
        raise Asked(options["numTrees"], options["maxDepth"])

    monkeypatch.setattr(regression, "RandomForestRegressor", forest)
    with pytest.raises(Asked) as found:
        j4_j5_random_forest(spark, sf)
    assert found.value.args == (400, 30)


def test_forest_rows_are_dealt_by_their_number_and_give_the_same_trees_again(spark, monkeypatch):
    """Many upstream partitions, most of them empty, would each make and send the statistics of all nodes."""
    from pyspark.ml import regression

    asked, real = [], regression.RandomForestRegressor.fit
    monkeypatch.setattr(regression.RandomForestRegressor, "fit", lambda self, df: asked.append((df.rdd.getNumPartitions(), df.count())) or real(self, df))
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") != 5, F.col("id") * 1.5).alias("y"))
    fit = lambda rows, **o: sorted((r["id"], r["p"]) for r in learning.forest_predictions(rows, df, ["x"], "y", "p", trees=3, **o).collect())
    assert fit(df.repartition(40)) == fit(df.repartition(9, "x"))
    fit(df.repartition(40), part_rows=100)
    assert asked == [(1, 299), (1, 299), (3, 299)]


def test_origins_ask_the_experts_of_every_target_and_horizon(spark):
    """Rows of an origin's reasons as the rules say: experts are asked only where history and features suffice."""
    import datetime

    from tidemark.operators import forecast as P

    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    required = [("gas", 1), ("gas", 2), ("volume", 1)]
    known = {20: ["gas:h1", "gas:h2", "volume:h1"], 21: ["gas:h2"], 22: ["gas:h1", "gas:h2", "volume:h1", "volume:h2"], 24: []}
    made = [("a", t.split(":h")[0], int(t.split(":h")[1]), day(i), "B11", 1.0, False) for i, names in known.items() for t in names]
    made += [("a", "volume", 1, day(21), "B10", 1.0, False), ("a", "gas", 1, day(21), "M2", 1.0, False), ("a", "gas", 1, day(24), "RIDGE", None, True)]
    made = spark.createDataFrame(made, "s string, target string, horizon int, origin_date date, expert string, prediction double, observed boolean")
    rows = spark.createDataFrame([("a", day(i), None if i == 22 else 1.0) for i in range(25)], "s string, date date, x double")
    have = P.experts_at(made, ["s"]).withColumnRenamed("origin_date", "date")
    found = P.origins(rows.join(have, ["s", "date"], "left"), ["s"], "date", ["x"], required=required)
    got = {r["origin_date"]: r["reasons"] for r in found.collect()}
    every = ["NO_EXPERT:gas:h1", "NO_EXPERT:gas:h2", "NO_EXPERT:volume:h1"]
    assert got[day(3)] == ["INSUFFICIENT_ROWS"] and got[day(20)] == [] and got[day(22)] == ["NON_FINITE_FEATURE"]
    assert got[day(21)] == ["NO_EXPERT:gas:h1", "NO_EXPERT:volume:h1"] and got[day(23)] == got[day(24)] == every
    assert P.latest_origin(found, ["s"]).first()["origin_date"] == day(20)
    assert sorted(r["origin_date"] for r in P.rejected(found, ["s"]).collect()) == [day(i) for i in (21, 22, 23, 24)]
