"""Weights of stacks by key and target, against each support tried one by one and against the optimality conditions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stacking as K


def tried(p, y):
    """The least loss over all supports, and its weights."""
    k, best, found = p.shape[1], 0.0, np.zeros(p.shape[1])
    for n in range(1, k + 1):
        for own in map(list, combinations(range(k), n)):
            w = np.linalg.lstsq(p[:, own], y, rcond=None)[0]
            if (w >= 0).all() and (loss := ((y - p[:, own] @ w) ** 2).sum() - (y**2).sum()) < best - 1e-9:
                best, found = loss, np.zeros(k)
                found[own] = w
    return found


def test_solver_finds_the_best_support():
    rng = np.random.default_rng(5)
    for k in (1, 2, 5, 8):
        p = rng.normal(size=(40, 30, k)) + rng.normal(size=(40, 30, 1)) * rng.choice([0, 3], size=(40, 1, 1))
        p *= 10.0 ** rng.integers(-4, 5, size=(40, 1, k))
        y = rng.normal(size=(40, 30))
        w, violation = K.solve_nonnegative(np.einsum("nri,nrj->nij", p, p), np.einsum("nri,nr->ni", p, y))
        assert violation.max() < 1e-9 and (w >= 0).all()
        for one, a, b in zip(w, p, y):
            assert np.allclose(one, tried(a, b), rtol=1e-6, atol=1e-9 / np.abs(a).max())


def test_solver_on_degenerate_problems():
    same = np.array([[1.0, 2.0, 3.0]] * 3).T  # three models that predict alike: the first takes the weight
    zero = np.array([[0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 2.0, 0.0]])
    sums = lambda p: p.T @ p
    y = np.array([2.0, 4.0, 6.0])
    w, violation = K.solve_nonnegative(np.stack([sums(same), sums(zero), sums(zero), sums(same)]), np.stack([same.T @ y, zero.T @ y, zero.T @ -y, same.T @ (0 * y)]))
    assert np.allclose(w, [[2, 0, 0], [0, 3, 0], [0, 0, 0], [0, 0, 0]]) and violation.max() < 1e-12
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 2))
    p = np.column_stack([base, base @ [0.5, 0.5], base @ [1.0, -1.0], base[:, 0]])  # rank 2 of 5
    w, violation = K.solve_nonnegative(sums(p)[None], (p.T @ (base @ [1.0, 2.0]))[None])
    assert violation[0] < 1e-9 and np.allclose(p @ w[0], base @ [1.0, 2.0])
    assert K.solve_nonnegative(np.zeros((0, 3, 3)), np.zeros((0, 3)))[0].shape == (0, 3)


def test_twelve_models_ten_thousand_keys_two_targets(spark):
    """Optimality of each problem, from the rows themselves: no descent along any model, none at all along those with a weight."""
    models = [f"m{i}" for i in range(12)]
    noise = lambda *by: F.xxhash64(*by) / 2.0**63
    df = spark.range(10_000 * 24).select((F.col("id") % 10_000).alias("key"), "id", (noise("id", F.lit("a")) + 1).alias("a"), noise("id", F.lit("b")).alias("b"))
    df = df.withColumns({m: F.col("a") * (i % 3) + F.col("b") * 0.3 + noise("id", F.lit(m)) for i, m in enumerate(models)})
    back = models[::-1]
    fitted = K.stacking_weights(df, ["key"], {"first": "a", "second": "b"}, {"first": models, "second": back})
    got = fitted.toPandas()
    assert len(got) == 20_000 and set(got["n"]) == {24} and got["violation"].max() < 1e-8
    w = np.stack(got["weights"])
    assert (w >= 0).all() and 1 < (w > 0).sum(axis=1).mean() < 12
    rows = df.filter("key < 20").toPandas().sort_values(["key", "id"])
    for r in got[got["key"] < 20].itertuples():
        own = rows[rows["key"] == r.key]
        names, truth = (models, "a") if r.target == "first" else (back, "b")
        p, y = own[names].to_numpy(), own[truth].to_numpy()
        slope = p.T @ (y - p @ r.weights)
        assert slope.max() < 1e-7 and np.abs(slope[np.array(r.weights) > 0]).max(initial=0) < 1e-7


def test_rows_that_cannot_be_used_and_keys_without_weights(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 2.0, 1.0, 5.0, 0), ("a", 4.0, 2.0, -5.0, 1), ("a", 9.0, None, 1.0, 2), ("a", nan, 1.0, 1.0, 3), ("a", 1.0, inf, 1.0, 4), (None, 3.0, 1.0, 0.0, 5), (None, 3.0, 1.0, 0.0, 6), ("few", 1.0, 1.0, 1.0, 7), ("none", None, 1.0, 1.0, 8)]
    df = spark.createDataFrame(rows, "k string, y double, p double, q double, weights int")
    fitted = K.stacking_weights(df, ["k"], {"t": "y"}, {"t": ["p", "q"]}, least=2)
    got = {r["k"]: (r["n"], [round(x, 9) for x in r["weights"]]) for r in fitted.collect()}
    assert got == {"a": (2, [2.0, 0.0]), None: (2, [3.0, 0.0])}
    out = {r["weights"]: r["s"] for r in K.stacked(df, ["k"], fitted, {"t": ["p", "q"]}, {"t": "s"}).collect()}
    assert {i: None if v is None else round(v, 9) for i, v in out.items()} == {0: 2.0, 1: 4.0, 2: None, 3: 2.0, 4: inf, 5: 3.0, 6: 3.0, 7: None, 8: None}
    assert K.stacking_weights(df.filter("false"), ["k"], {"t": "y"}, {"t": ["p", "q"]}).count() == 0
    assert [tuple(r) for r in K.weight_rows(fitted.filter("k = 'a'"), ["k"], ["P", "Q"]).select("model", F.round("weight", 6)).collect()] == [("P", 2.0), ("Q", 0.0)]
    with pytest.raises(ValueError):
        K.stacking_weights(df, ["weights"], {"t": "y"}, {"t": ["p", "q"]})
    with pytest.raises(ValueError):
        K.stacking_weights(df, ["k"], {"t": "y", "u": "y"}, {"t": ["p", "q"], "u": ["p"]})
