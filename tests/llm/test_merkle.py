"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout):
    """The last node, and each first node's siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
            paths[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], paths


def manifest(rows, fanout):
    """(id, group, leaf) to rows with subroot, root and proof."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: climb([r[2] for r in groups[g]], fanout) for g in order}
    root, tops = climb([subs[g][0] for g in order], fanout)
    return [(*r, subs[g][0], root, p + top) for g, top in zip(order, tops) for r, p in zip(groups[g], subs[g][1])]


def check(spark, rows, fanout, **clash):
    leaves = spark.createDataFrame(rows, "id long, lang string, leaf string").withColumns({k: F.lit(v) for k, v in clash.items()})
    got = merkle.merkle_manifest(leaves, ["id"], fanout=fanout)
    folded = got.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    found = sorted(((r["id"], r["lang"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["proof"]]) for r in folded), key=str)
    assert found == sorted(manifest(rows, fanout), key=str)
    assert all(r["again"] == r["root"] for r in folded)
    assert all(folded[0][k] == v for k, v in clash.items())


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_trees_of_any_size(spark, fanout):
    # Groups of one row, of whole and of partial blocks, and of several tiers; null and non-ASCII group names.
    sizes = {"a": 1, "b": 2, "Z": 8, "é": 9, None: 27, "z": 64, "big": 150}
    rows = [(i, g, h(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    check(spark, rows, fanout)


def test_many_groups_have_a_tree_of_their_own(spark):
    check(spark, [(i, f"g{i % 70}", h(str(i))) for i in range(150)], 2)


def test_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(None, "a", h("x")), (None, "a", h("y")), (3, "a", h("z")), (3, "a", h("z")), (3, "a", h("q")), (1, None, h("n"))]
    check(spark, rows, 2, _hash="clash", root2="clash", _at="clash", _g="clash", digit="clash")
    check(spark, rows[5:], 8)


def test_no_rows(spark):
    leaves = spark.createDataFrame([], "id long, lang string, leaf string")
    got = merkle.merkle_manifest(leaves, ["id"])
    assert got.columns == ["id", "lang", "leaf", "subroot", "root", "proof"] and got.count() == 0


def test_numbers_of_equal_rows_are_dealt_over_tasks(spark):
    rows = spark.range(4000).select(F.lit("k").alias("g"), F.lit(1).alias("o"))
    got = merkle.numbered(rows, "g", ["o"])
    assert got.filter("_n = 4000").select("_at").distinct().count() == 4000 and got.agg(F.max("_at")).first()[0] == 3999


def test_leaf_hashes_tell_fields_apart(spark):
    df = spark.createDataFrame([("a", None, 5), ("", "é", None), ("-", "", -3)], "a string, b string, c long")
    got = [r[0] for r in df.select(merkle.leaf_hash([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == [h("1:a", "-", "1:5"), h("0:", "2:é", "-"), h("1:-", "0:", "2:-3")]


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    leaves = spark.range(100).select("id", F.lit("x").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle.merkle_manifest(leaves, ["id"])
    assert got.filter(merkle.fold(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")).isEmpty()
