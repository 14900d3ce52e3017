"""Long series, cut into ranges, against the same operators on whole series."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, quality, series
from tidemark.operators import long_series as L


def rows_of(df):
    return sorted((tuple(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict(True).items())) for r in df.collect()), key=str)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)


@pytest.fixture(scope="module")
def gappy(spark):
    """Series of 1 to 90 rows with gaps at both ends and long gaps inside, one of nulls alone, and a null key."""
    rng = random.Random(4)
    rows = []
    for key, n, share in (("a", 90, 0.7), ("b", 1, 1), ("c", 40, 0.1), (None, 33, 0.5), ("d", 25, 0.0), ("e", 60, 0.02)):
        rows += [(key, i * 3, rng.randint(-9, 9) * 0.5 if rng.random() < share else None, rng.random()) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, v double, u double").repartition(3).cache()


@pytest.mark.parametrize("rows", [1, 4, 7, 1000])
def test_fills(gappy, rows):
    want = series.fill_both_ways(series.interpolate(gappy, ["k"], ["t"], {"v": "line"}), ["k"], ["t"], {"v": "held"})
    same(L.fill(gappy, ["k"], ["t"], {"v": "line"}, {"v": "held"}, rows=rows), want)


@pytest.mark.parametrize("rows", [3, 10])
def test_features_and_trends(gappy, rows):
    windows = {"windows": (2, 7), "lags": (1, 5), "retention": (4,), "loads": ["u"]}
    same(L.features(gappy, ["k"], ["t"], ["v"], rows=rows, **windows), series.features(gappy, ["k"], ["t"], ["v"], **windows))
    same(L.robust_trend(gappy, ["k"], ["t"], ["v"], rows=rows), series.robust_trend(gappy, ["k"], ["t"], ["v"]))
    same(L.by_ranges(gappy, ["k"], ["t"], lambda f, k, o: series.sequences(f, k, o, ["u"], rows=6), before=5, rows=rows), series.sequences(gappy, ["k"], ["t"], ["u"], rows=6))
    ahead = lambda f, k, o: f.withColumn("next", F.lead("u", 4).over(series.by(k, o)))
    same(L.by_ranges(gappy, ["k"], ["t"], ahead, after=4, rows=rows), ahead(gappy, ["k"], ["t"]))


@pytest.mark.parametrize("rows", [2, 9])
def test_days_and_kinetic_state(gappy, rows):
    daily = gappy.filter("k is not null").select("k", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t").cast("int")).alias("day"), "v")
    daily = daily.unionByName(daily.limit(1)).unionByName(daily.limit(1).withColumn("day", F.lit(None).cast("date")))
    dense = series.densify(daily, ["k"], "day")
    same(L.densify(daily, ["k"], "day", rows=rows), dense)
    load = dense.withColumn("v", F.coalesce("v", F.lit(1.5))).dropDuplicates(["k", "day"])
    same(L.kinetic_state(load, ["k"], "day", "v", 0.4, rows=rows), forecast.kinetic_state(load, ["k"], "day", "v", 0.4))


def cells(spark, seed):
    rng = random.Random(seed)
    out = []
    for key in range(12):
        v, flat = 5.0, key % 3 > 0
        for i in range(rng.choice([1, 8, 70])):
            kind = rng.random()
            v = v if kind < 0.55 else rng.choice([5.0, 5.5, 6.0, rng.gauss(5, 1), 60.0])
            there = kind < 0.9 and not (key == 5 and 10 < i < 60)
            out.append((key, i, v if there else None, "VALID" if there else "MISSING", "", flat))
    return spark.createDataFrame(out, "k long, i long, value double, status string, reason string, flatline boolean")


@pytest.mark.parametrize(("seed", "rows"), [(1, 1), (2, 3), (3, 8), (4, 20), (5, 500)])
def test_grades(spark, seed, rows):
    df = cells(spark, seed)
    want = quality.grade_history(df, ["k"], ["i"])
    assert want.select("status").distinct().count() >= 4
    same(L.grade_history(df, ["k"], ["i"], rows=rows), want)


def test_one_series_is_dealt_to_many_tasks(spark):
    df = spark.range(50_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 7, F.col("id") * 1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put so few rows into one task again
    try:
        got = L.fill(df, ["k"], ["t"], {"v": "line"}, rows=500)
        used = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("line").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(used) == 4 and max(r["n"] for r in used) < 20_000
    assert got.filter("line is null or abs(line - least(greatest(t, 7), 49007)) > 1e-9").isEmpty()


def test_no_rows(gappy):
    none = gappy.filter("false")
    assert L.fill(none, ["k"], ["t"], {"v": "line"}).count() == 0 and L.features(none, ["k"], ["t"], ["v"]).count() == 0


@pytest.mark.parametrize(("strict", "rows"), [(True, 3), (False, 5), (True, 1000)])
def test_as_of(spark, strict, rows):
    rng = random.Random(rows)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i) for i in range(60)]
    right = [(rng.choice(["a", "a", "c", None]), rng.choice([None, *range(0, 30, 3)]), i, f"r{i}") for i in range(40)]
    got = L.as_of(spark.createDataFrame(left, "k string, t int, n long"), spark.createDataFrame(right, "k string, u long, i long, name string"), ["k"], "t", "u", ["u", "name"], tie=["i"], strict=strict, rows=rows)
    want = []
    for k, t, n in left:
        known = [r for r in right if r[0] == k and r[1] is not None and t is not None and (r[1] < t or not strict and r[1] == t)]
        last = max(known, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((k, t, n, last[1], last[3]))
    assert got.columns == ["k", "t", "n", "u", "name"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
