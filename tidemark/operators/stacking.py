"""Stacks of models: for each key and target the weights of least squares without intercept and not below zero.

Rows are reduced to sums of products by one aggregate (combined before the shuffle, so that a hot key is no burden), and the small
problems of all keys are solved in batches, wherever their rows of sums are. A row of sums has about k * k / 2 numbers for k models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit-length predictions of which less than this is left once others explain them add nothing.
ALIKE = 1e-10


def solve_nonnegative(g: np.ndarray, y: np.ndarray, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """Weights w >= 0 of the least w'gw - 2w'y for many problems at once, and how far each is from optimal.

    g (problems, k, k) and y (problems, k) are sums of products. Models enter one at a time, the one with the steepest descent first and
    the first of equals; where a weight would turn negative, the step ends at zero and that model leaves. A model that those within
    explain already doesn't enter. The second result is the largest violation of the optimality conditions (descent that is left, and
    descent or ascent along a model with a weight) as a share of the largest entry of y, over predictions brought to unit length.
    """
    diagonal = np.einsum("nii->ni", g)
    empty = ~(diagonal > 0)
    length = np.sqrt(np.where(empty, 1.0, diagonal))
    g, y = g / length[:, :, None] / length[:, None, :], y / length
    n, k = y.shape
    own = np.eye(k)
    w, inside, barred = np.zeros((n, k)), np.zeros((n, k), bool), empty.copy()
    size = np.abs(y).max(axis=1, initial=0.0)

    def fitted(i: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Least squares of the models within, zero for the others."""
        m = np.where(inside[i][:, :, None] & inside[i][:, None, :], g[i], own)
        return np.linalg.solve(m, np.where(inside[i], right, 0.0)[:, :, None])[:, :, 0]

    going = np.flatnonzero(size > 0)
    for _ in range(50 * k):  # far beyond what is needed; a problem that rounding keeps from ending shows in its violation
        descent = y[going] - np.einsum("nij,nj->ni", g[going], w[going])
        descent[inside[going] | barred[going]] = -np.inf
        best = descent.argmax(axis=1)
        more = descent[np.arange(len(going)), best] > tolerance * size[going]
        going, best = going[more], best[more]
        if not len(going):
            break
        with_best = g[going, :, best]
        new = 1.0 - (np.where(inside[going], with_best, 0.0) * fitted(going, with_best)).sum(axis=1)
        barred[going[new < ALIKE], best[new < ALIKE]] = True
        i = going[new >= ALIKE]
        inside[i, best[new >= ALIKE]] = True
        while len(i):
            s = fitted(i, y[i])
            low = inside[i] & (s <= 0)
            done = ~low.any(axis=1)
            w[i[done]] = s[done]
            i, s, low = i[~done], s[~done], low[~done]
            if not len(i):
                break
            fall = w[i] - s
            share = np.where(low, np.divide(w[i], fall, out=np.zeros_like(fall), where=fall > 0), np.inf)
            step = share.min(axis=1)
            w[i] += step[:, None] * (s - w[i])
            out = (low & (share <= step[:, None])) | (inside[i] & (w[i] <= 0) & low)
            w[i] = np.where(out, 0.0, w[i])
            inside[i] &= ~out
            barred[i] = np.where((step > 0)[:, None], empty[i], barred[i] | out)
    descent = np.where(empty, 0.0, y - np.einsum("nij,nj->ni", g, w))
    violation = np.where(w > 0, np.abs(descent), np.maximum(descent, 0.0)).max(axis=1, initial=0.0)
    return w / length, violation / np.where(size > 0, size, 1.0)


def _complete(truths: Mapping[str, str], predictions: Mapping[str, Sequence[str]], df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, target, _y, _p: a row for each target whose truth and predictions are all there and finite."""
    cells = (F.struct(F.lit(t).alias("target"), F.col(y).cast("double").alias("_y"), F.array(*(F.col(p).cast("double") for p in predictions[t])).alias("_p")) for t, y in truths.items())
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  (NaN is above infinity)
    return df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*").filter(finite(F.col("_y")) & F.forall("_p", finite))


def stacking_weights(df: DataFrame, keys: Sequence[str], truths: Mapping[str, str], predictions: Mapping[str, Sequence[str]], *, least: int = 1) -> DataFrame:
    """keys, target, n (rows used), weights (an array in the order of predictions) and violation, a row for each key and target.

    truths: target to its column; predictions: target to one column for each model, as many for each target. Rows that lack the truth or
    a prediction, or have one that isn't finite, aren't used; with fewer than ``least`` rows a target has no weights and no row. Keys may
    be null, and mustn't be named target, n, weights or violation. Models that predict only zeros weigh nothing, and so does a model that
    those before it explain wholly.
    """
    sizes = {len(predictions[t]) for t in truths}
    if len(sizes) != 1 or 0 in sizes:
        raise ValueError("each target needs a prediction of every model")
    if taken := {"target", "n", "weights", "violation"} & set(keys):
        raise ValueError(f"keys may not be named {sorted(taken)}")
    k = sizes.pop()
    p = lambda i: F.col("_p")[i]
    products = [F.sum(p(i) * p(j)).alias(f"_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(p(i) * F.col("_y")).alias(f"_{i}_y") for i in range(k)]
    sums = _complete(truths, predictions, df, keys).groupBy(*keys, "target").agg(F.count("*").alias("n"), *products).filter(F.col("n") >= least)
    gram = F.array(*(F.col(f"_{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)))
    right = F.array(*(F.col(f"_{i}_y") for i in range(k)))

    @F.pandas_udf("weights array<double>, violation double")
    def solved(g, y):
        import pandas as pd

        w, violation = solve_nonnegative(np.stack(g).reshape(-1, k, k), np.stack(y)) if len(g) else (np.zeros((0, k)), np.zeros(0))
        return pd.DataFrame({"weights": list(w), "violation": violation})

    solved = solved.asNondeterministic()  # solved once for each row, however many of its fields are read
    return sums.select(*keys, "target", "n", solved(gram, right).alias("_s")).select(*keys, "target", "n", "_s.weights", "_s.violation")


def weight_rows(fitted: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """keys, target, model, weight: the arrays of stacking_weights as rows."""
    cells = F.arrays_zip(F.array(*(F.lit(m) for m in models)).alias("model"), F.col("weights").alias("weight"))
    return fitted.select(*keys, "target", F.explode(cells).alias("_c")).select(*keys, "target", "_c.model", "_c.weight")


def stacked(df: DataFrame, keys: Sequence[str], fitted: DataFrame, predictions: Mapping[str, Sequence[str]], names: Mapping[str, str]) -> DataFrame:
    """df with each target's weighted sum of predictions under its name; null where a key has no weights or a prediction is null.

    Each key's weights are one row, joined by key; nulls match nulls.
    """
    on = {f"_on_{i}": F.col(c) for i, c in enumerate(keys)} | {"_one": F.lit(1)}
    wide = fitted.select(*(e.alias(c) for c, e in on.items()), "target", "weights").groupBy(*on).agg(*(F.max(F.when(F.col("target") == t, F.col("weights"))).alias(f"_w{i}") for i, t in enumerate(predictions)))
    match = F.lit(1) == F.col("_one")
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"_on_{i}"))

    def total(i: int, columns: Sequence[str]) -> Column:
        return sum((F.col(c) * F.col(f"_w{i}")[j] for j, c in enumerate(columns)), F.lit(0.0))

    out = df.join(wide, match, "left")
    return out.select(*df.columns, *(total(i, predictions[t]).alias(names[t]) for i, t in enumerate(predictions)))
