"""Embedding near-dedup with hierarchical navigable small-world graphs (Malkov and Yashunin), one for each shard.

Vectors that are equal component by component are first collapsed to one. The rest are dealt, label by label, to shards of bounded
size, each with a graph; every vector of a label queries every shard of that label, in blocks. A query descends the graph greedily,
searches the ground layer with a beam, and then floods: from every vector found above the threshold it visits the neighbours, until none
above it is new. In each task, queries are audited against all vectors of the shard until enough true links are seen; while their recall
is too low, the beam is widened. A block with too few links for an audit, or whose recall stays too low, is compared exactly. Cosines are verified in double precision, links are counted where they are found, and
only a spanning forest of them leaves a task for the union of components.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import connected_components
from tidemark.llm.jaccard_join import forest

#: Queries that are compared with all vectors of a shard at once: 128 x 16,384 cosines are 17 MB.
SLICE = 128


class SmallWorld:
    """A navigable small-world graph over unit vectors, by cosine."""

    def __init__(self, vectors: np.ndarray, *, links: int = 12, beam: int = 48, seed: int = 11):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.x)
        self.links, self.most = links, 2 * links
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(links)).astype(int), 8) if n else np.zeros(0, int)
        self.ground = np.full((n, self.most), -1, np.int32)
        self.upper: list[dict[int, list[int]]] = [{} for _ in range(int(self.level.max()) if n else 0)]
        self.entry, self.top = -1, -1
        self.seen = np.zeros(n, np.int32)
        self.turn = 0
        for i in range(n):
            self._insert(i, beam)

    def _near(self, i: int, layer: int) -> np.ndarray:
        if layer:
            return np.array(self.upper[layer - 1].get(i, ()), np.int32)
        row = self.ground[i]
        return row[row >= 0]

    def _search(self, q: np.ndarray, start: list[int], beam: int, layer: int, least: float = 2.0, inside: list[int] | None = None) -> list[tuple[float, int]]:
        """The beam's (cosine, vector), best first. inside gets every vector met on the way whose cosine is at least ``least``."""
        self.turn += 1
        self.seen[start] = self.turn
        sims = self.x[start] @ q
        best = [(float(s), i) for s, i in zip(sims, start)]
        if inside is not None:
            inside += [i for s, i in best if s >= least]
        todo = [(-s, i) for s, i in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = self._near(i, layer)
            near = near[self.seen[near] != self.turn]
            if not len(near):
                continue
            self.seen[near] = self.turn
            for s, j in zip((self.x[near] @ q).tolist(), near.tolist()):
                if s >= least:
                    inside.append(j)
                if len(best) < beam:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(todo, (-s, j))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near vectors in different directions: one closer to a chosen one than to the query waits until the others are in."""
        ids = [i for _, i in found]
        between = self.x[ids] @ self.x[ids].T
        chosen, rest = [], []
        for k, (s, _) in enumerate(found):
            if len(chosen) >= most:
                break
            (rest if chosen and between[k, chosen].max() > s else chosen).append(k)
        chosen += rest[: most - len(chosen)]
        return [ids[k] for k in chosen]

    def _insert(self, i: int, beam: int) -> None:
        level = int(self.level[i])
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        q, start = self.x[i], [self.entry]
        for layer in range(self.top, level, -1):
            start = [self._search(q, start, 1, layer)[0][1]]
        for layer in range(min(self.top, level), -1, -1):
            found = self._search(q, start, beam, layer)
            for j in self._link(i, self._choose(found, self.links), layer):
                self._add(j, i, layer)
            start = [j for _, j in found]
        if level > self.top:
            self.entry, self.top = i, level

    def _link(self, i: int, near: list[int], layer: int) -> list[int]:
        if layer:
            self.upper[layer - 1][i] = list(near)
        else:
            self.ground[i, : len(near)] = near
        return near

    def _add(self, j: int, i: int, layer: int) -> None:
        """Gives j the neighbour i; of too many, the best chosen stay."""
        if layer:
            own = self.upper[layer - 1].setdefault(j, [])
            own.append(i)
            if len(own) > self.links:
                self.upper[layer - 1][j] = self._pruned(j, own, self.links)
            return
        row = self.ground[j]
        n = int((row >= 0).sum())
        if n < self.most:
            row[n] = i
            return
        kept = self._pruned(j, [*row.tolist(), i], self.most)
        row[:] = -1
        row[: len(kept)] = kept

    def _pruned(self, j: int, near: list[int], most: int) -> list[int]:
        s = self.x[near] @ self.x[j]
        order = np.argsort(-s, kind="stable")
        return self._choose([(float(s[k]), near[k]) for k in order], most)

    def within(self, q: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Vectors that the search finds at a cosine of at least ``least``."""
        if self.entry < 0:
            return np.zeros(0, np.int64)
        q, start = q.astype(np.float32), [self.entry]
        for layer in range(self.top, 0, -1):
            start = [self._search(q, start, 1, layer)[0][1]]
        met: list[int] = []
        self._search(q, start, beam, 0, least, met)
        edge = np.array(met, np.int64)
        inside = [edge]
        while len(edge):
            near = np.unique(self.ground[edge])
            near = near[near >= 0]
            near = near[self.seen[near] != self.turn]
            self.seen[near] = self.turn
            edge = near[self.x[near] @ q >= least].astype(np.int64)
            inside.append(edge)
        return np.unique(np.concatenate(inside))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are brought near 1 by a power of two first, which is exact, so that no square is lost or grows too large."""
    v = v.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0.0))[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def link_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    shard_rows: int = 16_384,
    beam: int = 16,
    audit: int = 48,
    recall: float = 0.98,
    most_beam: int = 512,
) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Links join vectors of equal, non-null labels at a cosine of at least ``least``. A vector that is null, empty, zero, or holds a null
    or non-finite component links with nothing, nor do vectors of different lengths. Ids are whole numbers; repeated rows with one id
    each count as a vector; rows with a null id link with nothing. Further columns are ignored; an empty table gives no rows.
    """
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    usable = d.filter(good).withColumn("key", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    # Equal vectors are one, with the number of copies.
    reps = cut(usable.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("size", F.size("v")))
    counts = reps.groupBy("label", "size").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    reps = reps.join(counts.select("label", "size", "shards"), ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    kind = d.schema["label"].dataType.simpleString()

    def build(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rep")
        x = unit(np.stack(b["v"].to_numpy()))
        graph = pickle.dumps((SmallWorld(x), x, b["rep"].to_numpy(np.int64), b["copies"].to_numpy(np.int64)), protocol=5)
        return pd.DataFrame({"label": b["label"].iloc[:1], "size": b["size"].iloc[:1], "shard": b["shard"].iloc[:1], "shards": b["shards"].iloc[:1], "graph": [graph]})

    built = cut(reps.select("label", "size", "shard", "shards", "rep", "copies", "v").groupBy("label", "size", "shard").applyInPandas(build, f"label {kind}, size int, shard int, shards int, graph binary"))
    # Each shard's graph meets each block of queries; a block is what another shard holds.
    graphs = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    queries = reps.select("label", "size", F.col("shard").alias("block"), "rep", "copies", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def search(shard: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({"u": [], "v": [], "n": []})
        graph, x, ids, copies = pickle.loads(shard["graph"].iat[0])
        b = b.sort_values("rep")
        own, q = b["rep"].to_numpy(np.int64), unit(np.stack(b["v"].to_numpy()))
        n, us, vs = np.zeros(len(q), np.int64), [], []
        for k, found in enumerate(links_found(graph, x, ids, q, own, least, beam, audit, recall, most_beam)):
            found = found[ids[found] != own[k]]
            n[k] = copies[found].sum()
            us.append(np.full(len(found), own[k]))
            vs.append(ids[found])
            if sum(map(len, us)) > 1 << 20:
                us, vs = map(lambda e: [e], forest(np.concatenate(us), np.concatenate(vs)))
        u, v = np.concatenate(us), np.concatenate(vs)
        u, v = forest(u, v) if len(u) else (u, v)
        linked = n > 0
        return pd.DataFrame({"u": np.concatenate([u, own[linked]]), "v": np.concatenate([v, own[linked]]), "n": np.concatenate([np.zeros(len(u), np.int64), n[linked]])})

    keys = ["label", "size", "shard", "block"]
    found = cut(graphs.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "u long, v long, n long"))
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("u <> v"))
    info = reps.select("label", "key", "rep", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    info = info.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    rows = usable.select("id", "label", "key").join(info, ["label", "key"]).select("id", "n_links", "component")
    rows = rows.unionByName(d.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return rows.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def exact_rows(x: np.ndarray, q: np.ndarray, least: float) -> list[np.ndarray]:
    """For each row of q, the vectors of x at a cosine of at least ``least``, by comparing all."""
    near = q @ x.T >= least - 1e-9
    return [exact(np.flatnonzero(r), x, v, least) for r, v in zip(near, q)]


def links_found(graph: SmallWorld, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, least: float, beam: int, audit: int, recall: float, most_beam: int) -> Iterator[np.ndarray]:
    """For each row of q, the vectors of x that it links with, through a beam whose audit passes, or else by comparing all.

    Queries are drawn and compared with all vectors until ``audit`` of them have a link, matches with themselves apart. Where fewer have
    one, all have been compared by then. A beam passes where the audited queries find ``recall`` of their links, in sum and on average.
    """
    drawn, truth = np.random.default_rng(len(q)).permutation(len(q)), {}
    for at in range(0, len(drawn), SLICE):
        if sum(len(t) > 0 for t in truth.values()) >= audit:
            break
        some = drawn[at : at + SLICE]
        truth |= {k: near[ids[near] != own[k]] for k, near in zip(some.tolist(), exact_rows(x, q[some], least))}
    if len(truth) == len(q):
        yield from (truth[k] for k in range(len(q)))
        return
    linked = {k: t for k, t in truth.items() if len(t)}
    want = np.array([len(t) for t in linked.values()])
    while beam <= most_beam:
        got = np.array([len(np.intersect1d(exact(graph.within(q[k], least - 1e-4, beam), x, q[k], least), t)) for k, t in linked.items()])
        if got.sum() >= recall * want.sum() and (got / want).mean() >= recall:
            yield from (exact(graph.within(v, least - 1e-4, beam), x, v, least) for v in q)
            return
        beam *= 2
    for at in range(0, len(q), SLICE):
        yield from exact_rows(x, q[at : at + SLICE], least)


def exact(found: np.ndarray, x: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Of the vectors found, those whose cosine in double precision reaches the threshold."""
    return found[x[found] @ q >= least]
