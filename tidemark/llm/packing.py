"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut; pieces are dealt to shards of bounded size, and each shard is packed best-fit
decreasing: a piece goes to the open bin that it leaves the least room in. Where none fits, a bin is opened whose size has the least
cost, ``(size + overhead) / what it is expected to hold``, judged against all lengths that the shard still has to place. In the end
each bin shrinks to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release_memory


def pack(lengths: np.ndarray, sizes: list[int], overhead: float = 16.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its offset in the bin, and each bin's final size."""
    sizes = sorted(sizes)
    top = sizes[-1]
    left = np.bincount(lengths, minlength=top + 1).astype(np.int64)  # pieces yet to be placed, by length
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    room: list[int] = []
    capacity: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the different rooms of open bins, ascending

    def expected(size: int, first: int) -> int:
        """What a bin of this size would hold if the largest pieces left that fit were put into it."""
        free, taken = size - first, {first: 1}
        while free > 0:
            fits = np.flatnonzero(left[1 : free + 1] - np.bincount([k for k, n in taken.items() for _ in range(n)], minlength=free + 1)[1 : free + 1] > 0)
            if not len(fits):
                break
            piece = int(fits[-1]) + 1
            taken[piece] = taken.get(piece, 0) + 1
            free -= piece
        return size - free

    opened: dict[int, tuple[int, int]] = {}
    for at in np.argsort(-lengths, kind="stable"):
        n = int(lengths[at])
        left[n] -= 1
        i = bisect.bisect_left(rooms, n)
        if i == len(rooms):
            # The choice for a length holds for a while: what is left changes little from piece to piece.
            size, uses = opened.get(n, (0, 0))
            if not uses:
                size = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / expected(s, n), s))
                uses = 32
            opened[n] = (size, uses - 1)
            b, free = len(room), size
            room.append(free)
            capacity.append(size)
        else:
            free = rooms[i]
            b = by_room[free].pop()
            if not by_room[free]:
                del by_room[free]
                rooms.pop(i)
        bins[at], offsets[at] = b, capacity[b] - free
        room[b] = free - n
        if room[b]:
            if room[b] not in by_room:
                by_room[room[b]] = []
                bisect.insort(rooms, room[b])
            by_room[room[b]].append(b)
    held = np.array(capacity, dtype=np.int64) - np.array(room, dtype=np.int64)
    return bins, offsets, np.array(sizes, dtype=np.int64)[np.searchsorted(sizes, held)] if len(held) else held


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", length_col: str = "n_tokens", sizes: tuple[int, ...] = (512, 1024, 2048, 4096), shard_rows: int = 20_000, overhead: float = 16.0) -> DataFrame:
    """One row for each piece: id, piece (from 0), start (in the document), length, bin, bin_size, offset (in the bin).

    ``bin`` is text, ``shard-number``. Documents of null, zero or negative length take no room and give no rows. Pieces of one
    document needn't share a bin. Repeated rows are packed one by one; an id may be null; an empty table gives an empty result. Ids and
    lengths are written once, and their pieces dealt to shards of about shard_rows by a hash of the row's number there, so that a task
    holds only its shard, however many rows share an id.
    """
    if not sizes or min(sizes) < 1:
        raise ValueError("sizes must be positive")
    top, sizes = max(sizes), sorted(set(sizes))
    d = docs.select(F.col(id_col).alias("_id"), F.col(length_col).cast("long").alias("_n")).filter("_n > 0")
    d = cut(d)
    pieces = d.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / top) - 1)).alias("piece"))
    pieces = pieces.select("_row", "_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("_n") - F.col("piece") * top).alias("length"))
    shards = max(1, -(-pieces.count() // shard_rows))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)).cast("int")).drop("_row")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "piece"], kind="stable").reset_index(drop=True)
        bins, offsets, held = pack(frame["length"].to_numpy(), sizes, overhead)
        shard = frame["shard"].iat[0]
        release_memory()
        return pd.DataFrame({"_id": frame["_id"], "piece": frame["piece"], "start": frame["start"], "length": frame["length"], "bin": [f"{shard}-{b}" for b in bins], "bin_size": held[bins], "offset": offsets})

    kind = d.schema["_id"].dataType.simpleString()
    packed = pieces.groupBy("shard").applyInPandas(run, f"_id {kind}, piece long, start long, length long, bin string, bin_size long, offset long")
    return packed.withColumnRenamed("_id", id_col)


def packed_sequences(docs: DataFrame, packed: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", pad_id: int = 0) -> DataFrame:
    """One row for each bin: bin, bin_size, ids (token ids, padded to bin_size), starts (offset of each document in it), documents (their ids).

    docs: distinct, non-null ids with their token ids; packed: pack_documents() of the same documents' lengths. A bin holds one sequence of
    at most the largest permitted length, so no group grows with the data.
    """
    own = docs.select(F.col(id_col).alias("_doc"), F.col(ids_col).alias("_ids"))
    cut_out = packed.join(own, F.col(id_col) == F.col("_doc")).select("bin", "bin_size", "offset", "_doc", F.slice("_ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("_part"))
    rows = cut_out.groupBy("bin", "bin_size").agg(F.array_sort(F.collect_list(F.struct("offset", "_doc", "_part"))).alias("_p"))
    ids = F.flatten(F.transform("_p", lambda x: x["_part"]))
    padded = F.concat(ids, F.array_repeat(F.lit(pad_id).cast(docs.schema[ids_col].dataType.elementType), (F.col("bin_size") - F.size(ids)).cast("int")))
    return rows.select("bin", "bin_size", padded.alias("ids"), F.transform("_p", lambda x: x["offset"]).alias("starts"), F.transform("_p", lambda x: x["_doc"]).alias("documents"))
