"""Ranks and rank correlations of groups of any size: a group's values are cut into ranges, which are ranked by different tasks.

A group's rows are spread by range over as many tasks as its size asks for, ties included. Each range gives a summary of its length and of
the values at its two ends, the only ones whose ties may go on in other ranges; the summaries (a row for each group and range) are added
up and joined back. Nulls in keys count as a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.long_series import joined
from tidemark.sources.store import written


def mean_ranks(df: DataFrame, keys: Sequence[str], value: str, spread: Sequence[str], name: str, *, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """df with ``name``, the rank of value in its group less the group's mean rank, (rows + 1) / 2; ties get the mean of their ranks.

    spread: columns that tell rows of one value apart, so that ties can be cut too; rows that are equal in them as well stay together.
    weight: how many rows a row stands for, itself alone without it. value mustn't be null; NaN is above all numbers. parts: ranges that
    the whole frame is cut into, by its size where not given. Columns that begin with an underscore are the operator's own.
    """
    order = [F.col(c) for c in [*keys, value, *spread]]
    rows = df.withColumn("_w", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    cut = written(ranged.withColumn("_part", F.spark_partition_id()))
    own = [*keys, "_part"]
    upto = F.sum("_w").over(Window.partitionBy(*own).orderBy(value))  # ties are within: the default frame is by value
    tied = F.sum("_w").over(Window.partitionBy(*own, value))
    local = cut.withColumns({"_upto": upto, "_tied": tied})
    ends = local.groupBy(*own).agg(F.sum("_w").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.min_by("_tied", value).alias("_low_n"), F.max_by("_tied", value).alias("_high_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_base": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_mean": (F.sum("_n").over(group) + 1) / 2})
    low = F.struct(F.lit(True).alias("is_low"), F.col("_low").alias("v"), F.col("_base").alias("start"), F.col("_low_n").alias("n"))
    high = F.struct(F.lit(False).alias("is_low"), F.col("_high").alias("v"), (F.col("_base") + F.col("_n") - F.col("_high_n")).alias("start"), F.col("_high_n").alias("n"))
    one_value = F.col("_low_n") == F.col("_n")
    both = ends.select(*own, "_base", "_mean", F.explode(F.when(one_value, F.array(low)).otherwise(F.array(low, high))).alias("_e")).select(*own, "_base", "_mean", "_e.*")
    same = Window.partitionBy(*keys, "v")
    both = both.withColumn("_rank", F.min("start").over(same) + (F.sum("n").over(same) + 1) / 2)
    at = lambda low, c: F.max(F.when(F.col("is_low") == low, F.col(c)))
    ends = both.groupBy(*own).agg(F.max("_base").alias("_base"), F.max("_mean").alias("_mean"), at(True, "v").alias("_low"), at(True, "_rank").alias("_low_rank"), at(False, "v").alias("_high"), at(False, "_rank").alias("_high_rank"))
    out = joined(local, ends, own)
    rank = F.when(F.col(value) == F.col("_low"), F.col("_low_rank")).when(F.col(value) == F.col("_high"), F.col("_high_rank"))
    rank = rank.otherwise(F.col("_base") + F.col("_upto") - F.col("_tied") + (F.col("_tied") + 1) / 2)
    return out.select(*df.columns, (rank - F.col("_mean")).alias(name))


def spearman(df: DataFrame, keys: Sequence[str], y: str, variables: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """stats.spearman for groups of any size: variable and r, the rank correlation with y over rows that have both, ties at their mean.

    Sums over rows need no pair's own row: the mean ranks of x are those of its distinct values with their counts; added up by y they
    leave a row for each distinct y, whose rank follows. Values that repeat are added up before they are sent. Groups without a row that
    has both are left out; r is null without spread.
    """
    rows = df.select(*keys, F.col(y).cast("double").alias("y"), *(F.col(v).cast("double").alias(f"x{i}") for i, v in enumerate(variables)))
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"x{i}").alias("x")) for i, v in enumerate(variables))))
    part = [*keys, "variable"]
    there = rows.select(*keys, "y", cells.alias("_c")).select(*keys, "_c.variable", "_c.x", "y").dropna(subset=["x", "y"])
    xs = written(mean_ranks(there.groupBy(*part, "x").agg(F.count("*").alias("times")), part, "x", [], "rx", weight="times", parts=parts))
    ranked = joined(there, xs.drop("times"), [*part, "x"])
    ys = ranked.groupBy(*part, "y").agg(F.count("*").alias("times"), F.sum("rx").alias("s"))
    both = mean_ranks(ys, part, "y", [], "ry", weight="times", parts=parts)
    n, z = F.col("times"), F.col("ry")
    sums = both.groupBy(*part).agg(F.sum(F.col("s") * z).alias("_xy"), F.sum(n * z * z).alias("_yy"))
    spread = xs.groupBy(*part).agg(F.sum(n * F.col("rx") * F.col("rx")).alias("_xx"))
    return joined(sums, spread, part).select(*part, F.try_divide("_xy", F.sqrt("_xx") * F.sqrt("_yy")).alias("r"))
