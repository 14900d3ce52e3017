"""A Merkle manifest of a dataset: a tree of hashes for each group, a root over the groups, and a proof for each row.

Rows are numbered in their group without gathering it: sorted ranges are counted, and each range starts where those before it end. The
digits of a number, in the base of the tree's fanout, say where a leaf stands. Within blocks of ``fanout ** LEVELS`` leaves the digits are
grouped away one after another, from the last to the first, each group becoming a struct that nests its children, so that one row at
the end holds a block's whole subtree; all of these aggregates run on one exchange by block. The blocks' hashes are the leaves of the
next tier, until each group has one node. Proofs come from taking the nested structs apart again, level by level, with a node's
siblings at hand in the row; no table of nodes is joined. Only a block's path above itself is joined to its row, once for each tier.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, partitions, schema_and

#: Levels of the tree within a block: at a fanout of 8 a block has up to 512 leaves, some 100 KB.
LEVELS = 3
#: A level of a proof: what stands left and right of the node in its run, put together as text.
STEP = "array<struct<left:string,right:string>>"


def field_text(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, columns)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (an array of steps from the leaf up) lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df with _at, each row's place (from 0) among those of its group by ascending order, nulls first, and _n, the group's number of rows.

    Rows that are equal in group and order stand in any order; a group, or rows that are equal, may be dealt to several tasks. What is
    gathered is one number for each sorted range and group in it. df should be a table, as it is read twice.
    """
    spread = cut(df.withColumn("_spread", F.monotonically_increasing_id()))
    ranges = spread.repartitionByRange(partitions(df.sparkSession), group, *order, "_spread").sortWithinPartitions(group, *order, "_spread").drop("_spread")
    schema = schema_and(ranges, _range="int", _local="long")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            keys = b.column(group)
            size = len(keys)
            if not size:
                continue
            code = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            local = np.arange(size) - np.repeat(starts, np.diff([*starts, size]))
            first, final = keys[0].as_py(), keys[size - 1].as_py()
            if n and first == last:
                local[: starts[1] if len(starts) > 1 else size] += n
            last, n = final, int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(size, part, np.int32)), pa.array(local, pa.int64())], names=[*b.schema.names, "_range", "_local"])

    rows = cut(ranges.mapInArrow(count, schema))
    sums = rows.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count("*").alias("_here"))
    own = Window.partitionBy("_group")
    sums = cut(sums.select("_group", "_of", (F.sum("_here").over(own.orderBy("_of")) - F.col("_here")).alias("_before"), F.sum("_here").over(own).alias("_n")))
    both = rows.join(sums, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.select(*df.columns, (F.col("_before") + F.col("_local")).alias("_at"), "_n")


def rolled_up(nodes: DataFrame, group: str, fanout: int) -> DataFrame:
    """One row for each block of nodes (group, _at, _n, _hash, _leaf): group, _block, _n, _hash and the nested _nodes of its levels.

    A level whose nodes are one in the whole group isn't hashed: its row holds the child's hash, and its child has no step there.
    """
    base = [F.expr(f"cast(_at div {fanout**k} % {fanout} as int)").alias(f"_d{k}") for k in range(LEVELS)]
    block = F.expr(f"_at div {fanout**LEVELS}").alias("_block")
    rows = nodes.select(group, block, "_n", *base, "_hash", F.col("_leaf").alias("_nodes")).repartition(group, "_block")
    for k in range(LEVELS):
        digits = [f"_d{j}" for j in range(k + 1, LEVELS)]
        run = F.array_sort(F.collect_list(F.struct(F.col(f"_d{k}").alias("digit"), F.col("_hash").alias("hash"), F.col("_nodes").alias("nodes"))))
        rows = rows.groupBy(group, "_block", *digits).agg(run.alias("_nodes"), F.max("_n").alias("_n"))
        hashes = F.col("_nodes.hash")
        several = F.col("_n") > fanout**k  # of this level's nodes in the group
        rows = rows.withColumn("_hash", F.when(several, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0]))
    return rows


def taken_apart(blocks: DataFrame, carry: Sequence[str], fanout: int) -> DataFrame:
    """The rows that blocks nest: carry, _hash and _leaf of each, and _steps from the node up to its block's root, then the block's own _steps."""
    rows = blocks
    for k in reversed(range(LEVELS)):
        rows = rows.select(*carry, "_n", "_steps", F.col("_nodes.hash").alias("_run"), F.posexplode("_nodes").alias("_pos", "_node"))
        left = F.array_join(F.slice("_run", F.lit(1), F.col("_pos")), "")
        right = F.array_join(F.slice("_run", F.col("_pos") + 2, F.lit(fanout)), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        steps = F.when(F.col("_n") > fanout**k, F.concat(step, F.col("_steps"))).otherwise(F.col("_steps"))
        rows = rows.select(*carry, "_n", steps.alias("_steps"), F.col("_node.hash").alias("_hash"), F.col("_node.nodes").alias("_nodes"))
    return rows.withColumnRenamed("_nodes", "_leaf")


def no_steps() -> Column:
    return F.array().cast(STEP)


def tree(leaves: DataFrame, group: str, fanout: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the leaves with _steps, the path from each block's root to its group's; and a row for each group: group, _hash, its root.

    leaves: group, _at, _n, _hash, _leaf. Each tier has fanout ** LEVELS times fewer rows than the one below; the number of tiers is
    the logarithm of the largest group.
    """
    tiers = []
    nodes, size = leaves, fanout**LEVELS
    while True:
        blocks = cut(rolled_up(nodes, group, fanout))
        tiers.append(blocks)
        if blocks.filter(F.col("_n") > size).isEmpty():  # each group is one block
            break
        smaller = F.ceil(F.col("_n") / size).cast("long").alias("_n")
        nodes = blocks.select(group, F.col("_block").alias("_at"), smaller, "_hash", F.struct(F.col("_block").alias("block")).alias("_leaf"))
    roots = tiers[-1].select(group, "_hash")
    steps = tiers[-1].withColumn("_steps", no_steps())
    for blocks in reversed(tiers[:-1]):
        above = taken_apart(steps, [group], fanout).select(F.col(group).alias("_above"), F.col("_leaf.block").alias("_of"), "_steps")
        steps = blocks.join(above, (F.col("_block") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_above"))).drop("_above", "_of")
    return steps, roots


def merkle_manifest(leaves: DataFrame, order: Sequence[str], *, group_col: str = "lang", leaf_col: str = "leaf", fanout: int = 8) -> DataFrame:
    """leaves with subroot (of the row's group), root and proof: the steps from the leaf up, to be folded by ``fold``.

    Leaves of a group stand by ascending order, nulls first, and where that is equal by their hashes; every ``fanout`` consecutive nodes
    (the last run: fewer, even one) become their hash until one is left, the group's subroot (a lone leaf: itself). Groups stand in
    ascending order, null first, strings by UTF-8 bytes; their subroots become the root in the same way. Null keys, repeated rows,
    groups of one row and columns of any name are as good as others; an empty table gives an empty result.
    """
    own = [c for c in leaves.columns if c != leaf_col]
    kept = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    rows = leaves.select(F.col(f"`{group_col}`").alias("_g"), *(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)), F.col(f"`{leaf_col}`").alias("_hash"), kept.alias("_leaf"))
    at = numbered(rows, "_g", [*(f"_o{i}" for i in range(len(order))), "_hash"]).select("_g", "_at", "_n", "_hash", "_leaf")
    blocks, subroots = tree(at, "_g", fanout)
    groups = numbered(cut(subroots.select(F.lit(0).alias("_all"), F.struct("_g").alias("_leaf"), F.col("_g").alias("_o"), "_hash")), "_all", ["_o"]).drop("_o")
    top, root = tree(groups, "_all", fanout)
    above = taken_apart(top, ["_all"], fanout).join(root.select(F.col("_all").alias("_every"), F.col("_hash").alias("_root")), F.col("_all") == F.col("_every"))
    above = cut(above.select(F.col("_leaf._g").alias("_above"), F.col("_hash").alias("_subroot"), F.col("_steps").alias("_top"), "_root"))
    joined = blocks.join(above, F.col("_g").eqNullSafe(F.col("_above"))).withColumn("_steps", F.concat("_steps", "_top"))
    out = taken_apart(joined, ["_subroot", "_root"], fanout)
    return out.select(*(F.col(f"_leaf.c{i}").alias(c) for i, c in enumerate(own)), F.col("_hash").alias(leaf_col), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_steps").alias("proof"))


def proof_hash(proof: Column) -> Column:
    """One hash over all siblings of a proof, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)
