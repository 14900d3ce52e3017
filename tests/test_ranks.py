"""Ranks by ranges against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks as R
from tidemark.operators import stats
from tidemark.sources.store import written


@pytest.fixture(scope="module")
def groups(spark):
    """Groups of many ties, of one value alone, of one row, of distinct values, with a null key, repeated rows, both zeros and infinities."""
    rng = random.Random(8)
    rows = [("ties", rng.choice([0.0, 0.0, -0.0, 1.5, 2.0]), float(rng.randint(0, 9)), i) for i in range(300)]
    rows += [("same", 4.0, float(i % 7), i) for i in range(60)] + [("one", 1.0, 2.0, 0)]
    rows += [(None, rng.random(), rng.random() ** 2, i) for i in range(80)] + [("copies", 3.0, 3.0, 1)] * 50 + [("copies", 2.0, 9.0, 1)] * 20
    rows += [("ends", v, w, i) for i, (v, w) in enumerate([(float("inf"), 1.0), (float("-inf"), 2.0), (0.0, 3.0), (None, 4.0), (5.0, None)])]
    rows += [("nothing", None, 1.0, 0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, x double, y double, i int").repartition(3).cache()


@pytest.mark.parametrize("parts", [1, 3, 16, None])
def test_ranks(groups, parts):
    there = groups.filter("x is not null")
    own, tied = Window.partitionBy("k"), Window.partitionBy("k", "x")
    plain = F.rank().over(own.orderBy("x")) + (F.count("*").over(tied) - 1) / 2 - (F.count("*").over(own) + 1) / 2
    rows = lambda df: sorted((str(r["k"]), r["x"] + 0.0, str(r["y"]), r["i"], r["r"]) for r in df.collect())
    assert rows(R.mean_ranks(there, ["k"], "x", ["y", "i"], "r", parts=parts)) == rows(there.withColumn("r", plain))
    assert rows(R.mean_ranks(there, ["k"], "x", [], "r", parts=parts)) == rows(there.withColumn("r", plain))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_spearman(groups, parts):
    rows = lambda df: sorted((str(r["k"]), r["variable"], None if r["r"] is None else round(r["r"], 9)) for r in df.collect())
    df = groups.withColumn("z", F.col("i") % 3)
    got = rows(R.spearman(df, ["k"], "y", ["x", "z"], parts=parts))
    assert got == rows(stats.spearman(df, ["k"], "y", ["x", "z"]))
    assert ("same", "x", None) in got and ("one", "x", None) in got and ("nothing", "x") not in {r[:2] for r in got}


def test_weights_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 2.0, 2)], "k string, v double, times int")
    got = sorted((r["v"], r["times"], r["r"]) for r in R.mean_ranks(df, ["k"], "v", ["times"], "r", weight="times", parts=2).collect())
    assert got == [(1.0, 3, -1.5), (2.0, 1, 1.5), (2.0, 2, 1.5)]
    assert R.mean_ranks(df.filter("false"), ["k"], "v", [], "r").count() == 0
    assert R.spearman(df.filter("false"), ["k"], "v", ["times"]).count() == 0
    whole = R.spearman(df, [], "v", ["times"]).collect()
    assert [r["variable"] for r in whole] == ["times"] and round(whole[0]["r"], 9) == round(-0.866025404, 9)


def test_ties_are_ranked_in_more_tasks_than_groups(spark, monkeypatch):
    """One value of one group, cut into several ranges by what tells its rows apart."""
    cut = []
    monkeypatch.setattr(R, "written", lambda df: cut.append(written(df)) or cut[-1])
    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit(7.0).alias("v"), "id")
    out = R.mean_ranks(df, ["k"], "v", ["id"], "r", parts=8)
    assert {r["r"] for r in out.select("r").distinct().collect()} == {0.0}
    sizes = [r["count"] for r in cut[0].groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_spearman_ranks_distinct_values_and_not_pairs(spark, monkeypatch):
    """Rows that repeat values in ever new pairs are added up before anything is sorted or written."""
    kept = []
    monkeypatch.setattr(R, "written", lambda df: kept.append(written(df)) or kept[-1])
    df = spark.range(4000).selectExpr("'k' k", "id % 4 x", "id div 4 % 50 + (id % 4) y")
    got = R.spearman(df, ["k"], "y", ["x"], parts=4).collect()
    want = stats.spearman(df, ["k"], "y", ["x"]).collect()
    assert [round(r["r"], 9) for r in got] == [round(r["r"], 9) for r in want]
    assert max(k.count() for k in kept) <= 53
