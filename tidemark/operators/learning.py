"""Training and evaluation of stacked regressions: splits, base models, non-negative weights, metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stacking import solve_nonnegative


def year_split(df: DataFrame, date: str, holdout: int) -> tuple[DataFrame, DataFrame]:
    """Rows before the year and rows of it."""
    return df.filter(F.year(date) < holdout), df.filter(F.year(date) == holdout)


def meta_split(train: DataFrame, date: str, years: int = 2) -> DataFrame:
    """train with block: meta for its last years, early before."""
    last = train.agg(F.max(F.year(date)).alias("_last"), F.lit(1).alias("_one"))  # one row
    out = train.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")
    return out.withColumn("block", F.when(F.year(date) > F.col("_last") - years, "meta").otherwise("early")).drop("_last", "_one")


def tail_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], share: float = 0.15) -> DataFrame:
    """df with tail: whether a row is in the last share of its key, one row at least."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("tail", at > n - F.greatest(F.lit(1), F.floor(n * share)))


def forest_predictions(train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, prediction: str, *, trees: int = 400, least_leaf: int = 2, seed: int = 42, part_rows: int = 2000) -> DataFrame:
    """rows with a random forest's predictions, its trees as deep as Spark allows (30); rows lacking a feature are left out of both.

    Each row's node in each tree is kept with the rows, so that a level sends the nodes it splits and not all trees so far; many nodes are
    split in one pass over the rows, which are assembled once. A task of a level makes and sends the statistics of all the nodes that are
    split, whether it has rows of them or none, so rows are dealt to few partitions, of ``part_rows`` rows or one for each core.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    assemble = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol=prediction, numTrees=trees, minInstancesPerNode=least_leaf, maxDepth=30, seed=seed, cacheNodeIds=True, maxMemoryInMB=1024)
    used = train.dropna(subset=[*features, target]).select(*features, target)
    parts = min(-(-used.count() // part_rows) or 1, used.sparkSession.sparkContext.defaultParallelism)
    dealt = used.repartition(parts, F.xxhash64(*features, target)).sortWithinPartitions(*features, target)  # in one order, so that the trees are the same again
    fitted = assemble.transform(dealt).select("_x", target).persist()
    try:
        model = forest.fit(fitted)
    finally:
        fitted.unpersist()
    return model.transform(assemble.transform(rows)).drop("_x")


def gram(df: DataFrame, keys: Sequence[str], predictions: Sequence[str], target: str) -> DataFrame:
    """Sums of products of predictions with each other and with the target: all that the weights need."""
    rows = df.dropna(subset=[*predictions, target])
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for i, a in enumerate(predictions) for b in predictions[i:]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *pairs, *(F.sum(F.col(a) * F.col(target)).alias(f"{a}__y") for a in predictions))


def nonnegative_weights(sums: dict, predictions: Sequence[str]) -> list[float]:
    """Weights of least squares without intercept and not below zero, from one row of gram(); stacking.py has them for many keys and targets."""
    k = range(len(predictions))
    g = np.array([[sums[f"{predictions[min(i, j)]}__{predictions[max(i, j)]}"] for j in k] for i in k], float)
    return solve_nonnegative(g[None], np.array([[sums[f"{a}__y"] for a in predictions]], float))[0][0].tolist()


def combine(weights: dict[str, float]) -> Column:
    """Weighted sum of prediction columns."""
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.col(c) * F.lit(w)
    return out


def normalise(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """share: the weight over its key's sum, 4 digits; a sum of zero counts as one."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.round(F.col(weight) / F.when(total == 0, 1.0).otherwise(total), 4))


def prediction_table(df: DataFrame, keys: Sequence[str], target: str, prediction: Column, diagnostics: Sequence[str]) -> DataFrame:
    """keys, true, predicted and the diagnostics of each held-out row that has both a truth and a prediction."""
    out = df.select(*keys, F.col(target).alias("true"), prediction.alias("predicted"), *diagnostics)
    return out.filter(F.col("true").isNotNull() & F.col("predicted").isNotNull())


def model_table(df: DataFrame, predictions: Sequence[str], target: str) -> DataFrame:
    """model, n, r2, rmse, mae of several prediction columns in one pass."""
    from tidemark.operators.stats import regression_metrics

    long = df.select(target, *predictions).unpivot([target], list(predictions), "model", "prediction")
    return regression_metrics(long, ["model"], target, "prediction")
