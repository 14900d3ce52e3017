"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) for every id that an edge (u, v) has.

    Loops and repeated edges do no harm; edges with a null end are left out. An id with many edges isn't gathered anywhere: its
    smallest neighbour is an aggregate, and the join that spreads it can be split. Each round's edges are checkpointed.
    """
    shared_folder(edges.sparkSession)
    start = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna().checkpoint()  # it is read twice
    ids = start.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    e = start.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u joins the smallest of u and its neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: u and its smaller neighbours join the smallest of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
