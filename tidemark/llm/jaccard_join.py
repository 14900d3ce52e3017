"""N-gram Jaccard self-join of documents by token-combination prefixes.

A document is the set of its distinct word shingles; of equal sets, only the smallest id is indexed (a bitmap of these ids lets few others
pass). Tokens are ordered from rare to frequent, by a bounded table of the most frequent tokens, and a bitmap of bounded size of those that
stand in more than one document, both from a count over all documents. Sets of n tokens that are similar enough share at least
``a = ceil(t * n)`` tokens, and the k least of those stand among the first ``n - a + k`` tokens of both: the prefix, extended for k. Rare
tokens of the prefix for k = 1 are index keys by themselves. If the least shared token is frequent, so are all, and k of them stand in both
extended prefixes; with these dealt into k - 1 groups by a hash, two shared ones meet in a group, so that the combinations of two within
groups are keys. k grows with n, which keeps these keys to about as many as a set has tokens.

Similar sets also have sizes within the threshold of each other. The documents of a key of up to 32 give the pairs whose sizes are close
enough. Such keys are often shared by chance, the more the larger the corpus, and would tie most documents into one group; so a pair
counts only if the two sets' sketches, of a bit or two for each shingle, leave room for enough common shingles, which those of similar
sets always do. A key of more documents links them in a chain by size, where neighbours are close enough, not in pairs. It is reduced in
each task before it is shuffled: of its documents whose sizes are of one narrow class, the first and the last leave the task, however many
there are. The connected groups of these candidates are verified on their words, with exact set sizes: whole groups in one task where they
are small, and by pairs of blocks where they are large, so that no task holds an unbounded group. Blocks follow the order of set sizes, and
pairs of blocks whose sizes are too far apart are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_block, cut, partitions, release_memory, small_batches, text_bytes
from tidemark.llm.components import connected_components
from tidemark.llm.hashing import mix, window_hashes, word_hashes, words_of

BASE = 0x9E3779B97F4A7C15
#: Bytes of text for each bucket of counts and keys, so that a task's bucket stays as large with any number of documents.
BUCKET_BYTES = 16 << 20
#: Entries that a task gathers before it reduces and emits them.
FLUSH = 1 << 19
#: Documents of a key up to which its pairs are listed; more are linked in a chain.
LISTED = 32
#: In a size that leaves a task: the key has had more than LISTED documents there.
CHAINED = np.uint32(1 << 31)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole text is one where it has fewer words, and none without words."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(width, len(h)), BASE))


def digest(*tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(b"".join(t.tobytes() for t in tokens), digest_size=16).digest()


def sketch(tokens: np.ndarray) -> bytes:
    """How often tokens hash to each of some bits, even or odd: one to two bits for each token, 64 at least."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """Whether sets of n and m tokens with these sketches can be similar; each odd bit of their difference is a token that one of them lacks."""
    x, y = (int.from_bytes(s, "little") for s in (a, b))
    bits = 8 * min(len(a), len(b))
    x, y = (folded(v, 8 * len(s), bits) for v, s in ((x, a), (y, b)))
    most = (n + m - (x ^ y).bit_count()) // 2
    return 100 * most >= percent * (n + m - most)


def folded(x: int, bits: int, fewer: int) -> int:
    """The sketch of the same tokens with fewer bits."""
    while bits > fewer:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def profile_of(text: str | None, width: int) -> tuple[int, bytes | None, bytes | None, bytes | None]:
    """The set's size, the digest of its hashes, one that a second hash of each shingle's words goes into: equal for equal sets only, and its sketch."""
    words = words_of(text, lower=True)
    if not words:
        return 0, None, None, None
    width = min(width, len(words))
    tokens, at = np.unique(window_hashes(word_hashes(words), width, BASE), return_index=True)
    second = window_hashes(word_hashes(words, seed=1), width, BASE)[at]
    return len(tokens), digest(tokens), digest(tokens, second), sketch(tokens)


def exact_sets(docs: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of documents given as word numbers, as numbers that are equal for equal words only."""
    lengths = np.array([len(d) for d in docs])
    words = np.concatenate(docs)
    several = int(words.max()) + 1
    code = words
    for j in range(1, width):
        # Numbers stay below the count of words, so that a product with the next word fits 64 bits.
        code = np.unique(code[: len(words) - j], return_inverse=True)[1] * several + words[j:] if len(words) > j else code[:0]
    most = int(code.max()) + 1 if len(code) else 0
    short: dict[tuple, int] = {}
    starts = np.cumsum(lengths) - lengths
    return [np.unique(code[s : s + n - width + 1]) if n >= width else np.array([most + short.setdefault(tuple(d.tolist()), len(short))]) for d, s, n in zip(docs, starts.tolist(), lengths.tolist())]


def least_common(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with a similar one."""
    return -(-n * percent // 100)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges, one for each id that isn't the smallest of its component: (id, smallest)."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def by_size(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and sizes in the order of keys, then sizes."""
    order = np.lexsort((docs, sizes, keys))
    return keys[order], docs[order], sizes[order]


def sharing(keys: np.ndarray, values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
    """For each of sorted keys, the values of all its entries put together."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    return how.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1] if len(keys) else values


def chains(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of entries by_size, an edge between those of a key that stand step apart and whose sizes are close enough."""
    close = (keys[step:] == keys[:-step]) & (sizes[:-step] * 100 >= sizes[step:] * percent) & (docs[step:] != docs[:-step])
    return docs[step:][close], docs[:-step][close]


def listed_pairs(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries by_size, LISTED of a key at most, each distinct pair (smaller, larger id) of a key whose sizes are close enough."""
    found = [chains(keys, docs, sizes, percent, step) for step in range(1, LISTED)]
    u, v = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def outer(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of sorted keys and sizes, the first and last of each key and size class; a class spans a factor of 1.15."""
    c = (np.log(sizes) / np.log(1.15)).astype(np.int64)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (c[1:] != c[:-1])])
    return new | np.concatenate([new[1:], [True]])


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, split into planes of bytes, which Spark's shuffle compresses well."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values[:1] * 0)
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(len(gaps), -1).T).tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def bitmap_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits with the spots of all ids."""
    spot = ids.select(spot_of(F.col("id"), bits).alias("spot"))
    words = spot.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint8)


def spot_of(ids: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(1 << bits))


def indexed(b: pd.DataFrame, spots: np.ndarray) -> pd.DataFrame:
    """The rows whose spot is in the bitmap."""
    at = b["spot"].to_numpy()
    return b[(spots[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]


def frequent_tokens(docs: DataFrame, width: int, buckets: int, first: tuple[dict, np.ndarray], least: int, most: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first: groups of copies by digest, and the bitmap of the ids that are indexed. 32-bit token hashes, ascending, and in how many documents each stands: the ``most`` most frequent ones of at least ``least``;
    and a bitmap of 2 ** bits, by the tokens' first bits, of those in more than one document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(first)
    shift = 32 - bits + 3  # a token's byte in the bitmap
    starts = np.arange(buckets + 1) * (1 << 32) // buckets

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, spots = shared.value
        held, n = [], 0

        def flush():
            v = np.sort(np.concatenate(held))
            at = np.searchsorted(v, starts.astype(np.uint64))
            return pd.DataFrame({"bucket": np.arange(buckets), "tokens": [packed(v[a:b].astype(np.uint32)) for a, b in zip(at, at[1:])]})

        for b in batches:
            b = indexed(b, spots)
            for i, text in zip(b["doc_id"], b["text"]):
                s = shingle_set(text, width)
                if len(s) and hot.get(digest(s), i) == i:
                    held.append(s >> np.uint64(32))
                    n += len(s)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        held = []
        release_memory()

    def count(b: pd.DataFrame) -> pd.DataFrame:
        v, n = np.unique(np.concatenate([unpacked(x, np.uint32) for x in b["tokens"]]), return_counts=True)
        k = int(b["bucket"].iat[0])
        first, last = int(starts[k]) >> shift, (int(starts[k + 1]) - 1) >> shift
        own = np.zeros(last - first + 1, np.uint8)
        several = v[n > 1].astype(np.int64)
        np.bitwise_or.at(own, (several >> shift) - first, (1 << ((several >> (shift - 3)) & 7)).astype(np.uint8))
        found = pd.DataFrame({"token": v[n >= least].astype(np.int64), "n": n[n >= least], "bits": None})
        return pd.concat([found, pd.DataFrame({"token": [first], "n": [0], "bits": [own.tobytes()]})])

    counts = cut(by_block(docs.mapInPandas(gather, "bucket int, tokens binary"), buckets, "bucket", count, "token long, n long, bits binary"))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in counts.filter("n = 0").toLocalIterator():
        own = np.frombuffer(r["bits"], np.uint8)
        bitmap[r["token"] : r["token"] + len(own)] |= own
    found = counts.filter("n > 0").select("token", "n").orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = (np.array(found.column(c).to_numpy()) for c in ("token", "n"))
    order = np.argsort(token)
    return token[order].astype(np.uint32), n[order], bitmap


def document_counts(s: np.ndarray, table: np.ndarray, count: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """In how many documents each token stands: exact in the table, else 2 for several and 1 for one."""
    fold = s >> np.uint64(32)
    shift = np.uint64(32 - int(np.log2(len(bitmap))))
    df = 1 + ((bitmap[fold >> shift] >> ((fold >> (shift - np.uint64(3))) & np.uint64(7)).astype(np.uint8)) & 1).astype(np.int64)
    if len(table):
        at = np.minimum(np.searchsorted(table, fold.astype(np.uint32)), len(table) - 1)
        df = np.where(table[at] == fold, count[at], df)
    return df


def combinations(s: np.ndarray, groups: int) -> np.ndarray:
    """A key for each two tokens that the same of some groups, told by their hashes, holds."""
    group = s % np.uint64(groups)
    order = np.lexsort((s, group))
    s, group = s[order], group[order]
    found = []
    for step in range(1, len(s)):
        both = group[step:] == group[:-step]
        if not both.any():
            break
        with np.errstate(over="ignore"):
            found.append(mix(s[:-step][both] * np.uint64(BASE) + s[step:][both]))
    return np.concatenate(found) if found else s[:0]


def prefix_keys(s: np.ndarray, df: np.ndarray, percent: int, frequent: int) -> np.ndarray:
    """The index keys of a set whose tokens stand in df documents: see the module's text."""
    n = len(s)
    a = least_common(n, percent)
    order = np.lexsort((s, df))
    s, often = s[order], df[order] >= frequent
    base = n - a + 1
    keys = [s[:base][~often[:base]]]
    if often[base - 1]:
        # Of two similar sets, the smaller's size decides on k, by powers of two; this set may be the smaller or the larger.
        for level in range(a.bit_length() - 1, n.bit_length()):
            k = min(max(2, (1 << level) // 5), least_common(1 << level, percent))
            prefix = s[: n - a + k][often[: n - a + k]]
            keys.append(combinations(prefix, k - 1) if k > 1 else prefix)
    return np.unique(np.concatenate(keys))


def candidate_edges(docs: DataFrame, width: int, buckets: int, percent: int, first: tuple[dict, np.ndarray], table: tuple, frequent: int) -> DataFrame:
    """u, v, listed: the pairs of each key that a few documents have, listed, and a chain for each that many have."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((*first, *table))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        copies, spots, *counts = shared.value
        keys, ids, sizes, n = [], [], [], 0

        def flush():
            lengths = [len(x) for x in keys]
            k, d, m = np.concatenate(keys), np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
            k, d, m = by_size(k, d, m)
            many = sharing(k, np.ones(len(k), np.int64)) > LISTED
            u, v = chains(k[many], d[many], m[many], percent)
            m = m.astype(np.uint32) | np.where(many, CHAINED, np.uint32(0))
            leave = ~many
            if many.any():
                leave[many] = outer(k[many], m[many] & ~CHAINED)
            k, d, m = k[leave], d[leave], m[leave]
            at = [*np.searchsorted(k, np.array([i * (1 << 64) // buckets for i in range(buckets)], dtype=np.uint64)).tolist(), len(k)]
            found = pd.DataFrame({"bucket": np.arange(buckets), "kind": 1} | {c: [x[a:b].tobytes() for a, b in zip(at, at[1:])] for c, x in (("a", k), ("b", d), ("c", m))})
            if len(u):
                u, v = forest(u, v)
                found = pd.concat([found, pd.DataFrame({"bucket": [int(u[0] % buckets)], "kind": 0, "a": [u.tobytes()], "b": [v.tobytes()], "c": [b""]})])
            return found

        for b in batches:
            b = indexed(b, spots)
            for i, text in zip(b["doc_id"], b["text"]):
                s = shingle_set(text, width)
                if not len(s) or copies.get(digest(s), i) != i:
                    continue
                k = prefix_keys(s, document_counts(s, *counts), percent, frequent)
                keys.append(k)
                ids.append(i)
                sizes.append(len(s))
                n += len(k)
                if n >= FLUSH:
                    yield flush()
                    keys, ids, sizes, n = [], [], [], 0
        if n:
            yield flush()
        keys = []
        release_memory()

    def link(b: pd.DataFrame) -> pd.DataFrame:
        own, rest = b[b["kind"] == 1], b[b["kind"] == 0]
        k, d, m = (np.frombuffer(b"".join(own[c]), t) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.uint32)))
        order = np.argsort(k, kind="stable")
        several = np.zeros(len(k), bool)
        several[order] = sharing(k[order], np.ones(len(k), np.int64)) > 1
        chained = (m & CHAINED) > 0
        several |= chained
        k, d, m, chained = k[several], d[several], (m & ~CHAINED)[several].astype(np.int64), chained[several]
        order = np.lexsort((d, m, k))
        k, d, m, chained = k[order], d[order], m[order], chained[order]
        many = (sharing(k, np.ones(len(k), np.int64)) > LISTED) | sharing(k, chained, np.logical_or)
        x, y = listed_pairs(k[~many], d[~many], m[~many], percent)
        u, v = chains(k[many], d[many], m[many], percent)
        u = np.concatenate([u, np.frombuffer(b"".join(rest["a"]), np.int64)])
        v = np.concatenate([v, np.frombuffer(b"".join(rest["b"]), np.int64)])
        u, v = forest(u, v) if len(u) else (u, v)
        return pd.DataFrame({"u": np.concatenate([u, x]), "v": np.concatenate([v, y]), "listed": np.arange(len(u) + len(x)) >= len(u)})

    return by_block(docs.mapInPandas(gather, "bucket int, kind int, a binary, b binary, c binary"), buckets, "bucket", link, "u long, v long, listed boolean").distinct()


def possible_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose sketches allow a link. sets: id, n, sketch, by which pairs of other ids are dropped."""
    rows = pairs.select("u", "v")
    for c in ("u", "v"):
        rows = rows.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [may_link(*x, percent) for x in zip(b["n_u"], b["sketch_u"], b["n_v"], b["sketch_v"])]
            yield b.loc[np.array(found, bool), ["u", "v"]]

    return rows.select("u", "v", "n_u", "sketch_u", "n_v", "sketch_v").mapInPandas(keep, "u long, v long")


def similar_pairs(sets: list[np.ndarray], other: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs with percent * |union| <= 100 * |intersection|: within sets, or between sets and other."""
    rows = sets if other is None else [*sets, *other]
    size = np.array([len(s) for s in rows], np.int64)
    tokens = np.concatenate(rows)
    _, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
    several = n > 1
    column = np.cumsum(several) - 1
    row = np.repeat(np.arange(len(rows)), size)
    keep = several[at]
    row, col, width = row[keep], column[at[keep]], int(several.sum())
    cut_at = len(sets) if other is not None else None
    left = len(rows) if cut_at is None else cut_at
    both = np.zeros((left, len(rows) if cut_at is None else len(other)), np.float32)
    step = max(1, (1 << 23) // max(1, len(rows)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, width, step):
        x, y = np.searchsorted(col, (lo, lo + step))
        m = np.zeros((len(rows), min(step, width - lo)), np.float32)
        m[row[x:y], col[x:y] - lo] = 1
        both += m[:left] @ (m if cut_at is None else m[cut_at:]).T
    inter = both.astype(np.int64)
    total = size[:left, None] + (size if cut_at is None else size[cut_at:])[None, :] - inter
    i, j = np.nonzero(100 * inter >= percent * total)
    if cut_at is None:
        i, j = i[i < j], j[i < j]
    return i, j


def verified_edges(docs: DataFrame, groups: DataFrame, width: int, percent: int, block_tokens: int, block_docs: int, broadcast_rows: int) -> DataFrame:
    """u, v: for each candidate group and block pair, a forest of its documents' true links. groups: doc_id, component, n."""
    spark = docs.sparkSession
    sizes = groups.groupBy("component").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    sizes = sizes.filter("docs > 1").withColumn("blocks", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("docs") / block_docs)).cast("int"))
    small, large = sizes.filter("blocks = 1"), cut(sizes.filter("blocks > 1").select("component", "blocks"))
    pair = ["doc_id", "component", "block", "i", "j"]
    made = groups.join(small.select("component"), "component").select("doc_id", "component", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    if not large.isEmpty():
        # Large groups: bands of set sizes, and in each as many blocks as its documents take, dealt by a hash.
        own = groups.join(large, "component")
        edges = own.groupBy("component").agg(F.percentile_approx("n", F.array(*(F.lit(k / 64) for k in range(1, 64))), 1_000).alias("cuts"))
        own = own.join(edges, "component").withColumn("band", F.size(F.filter("cuts", lambda c: c < F.col("n"))))
        bands = own.groupBy("component", "band").agg(F.greatest(F.ceil(F.sum("n") / block_tokens), F.ceil(F.count("*") / block_docs)).alias("parts"))
        own = own.join(bands, ["component", "band"]).withColumn("block", (F.col("band") * (1 << 24) + F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int"))
        spans = cut(own.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")))
        x, y = spans.alias("x"), spans.alias("y")
        near = (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.high") * 100 >= F.col("y.low") * percent) & (F.col("y.high") * 100 >= F.col("x.low") * percent)
        meet = x.join(y, near).select(F.col("x.component").alias("component"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
        meet = meet.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        made = made.unionByName(own.select("doc_id", "component", "block").join(meet, ["component", "block"]).select(*pair))
    groups = cut(made)
    rows = docs.join(F.broadcast(groups) if groups.count() <= broadcast_rows else groups, "doc_id")
    rows = rows.repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, numbers = None, [], {}

        def links():
            first, second = [x for x in held if x[1] == key[1]], [x for x in held if x[1] == key[2]]
            if not first or not second or len(held) < 2:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            a, b = (np.array([d for d, *_ in x], np.int64) for x in (first, second))
            if key[1] == key[2]:
                i, j = similar_pairs(exact_sets([w for *_, w in first], width), None, percent)
                return a[i], a[j]
            sets = exact_sets([w for *_, w in [*first, *second]], width)
            i, j = similar_pairs(sets[: len(first)], sets[len(first) :], percent)
            return a[i], b[j]

        def found():
            u, v = links()
            u, v = forest(u, v) if len(u) else (u, v)
            return pd.DataFrame({"u": u, "v": v})

        for b in batches:
            out = []
            for d, text, c, block, i, j in zip(b["doc_id"], b["text"], b["component"], b["block"], b["i"], b["j"]):
                if (c, i, j) != key:
                    if held:
                        out.append(found())
                    key, held, numbers = (c, i, j), [], {}
                words = words_of(text, lower=True)
                if words:
                    held.append((d, block, np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)))
            if out:
                yield pd.concat(out)
        if held:
            yield found()
        held, numbers = [], {}
        release_memory()

    return rows.select("doc_id", "text", "component", "block", "i", "j").mapInPandas(verify, "u long, v long")


def jaccard_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    frequent: int = 256,
    table_tokens: int = 1_000_000,
    bitmap_bits: int = 27,
    id_bits: int = 26,
    hot_groups: int = 100_000,
    broadcast_rows: int = 1_000_000,
    block_tokens: int = 2_000_000,
    block_docs: int = 1_024,
) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Ids are whole numbers. Texts without words, null ones among them, have no shingles and link with nothing; texts with fewer than
    ``width`` words are one shingle. Rows with a null id link with nothing and have a null component. Equal sets link. Rows that share
    an id are one document for links, also where their texts differ. Candidates are found by 64-bit hashes and compared by their words;
    sets count as equal where two 64-bit hashes of each shingle are. ``table_tokens``, ``bitmap_bits``, ``id_bits`` and ``hot_groups`` bound
    what executors get: they decide how keys are ordered and how many copies are indexed, never what links. Further columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    buckets = max(4, -(-text_bytes(d) // BUCKET_BYTES))

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [profile_of(t, width) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64")} | {c: [x[k] for x in made] for k, c in enumerate(("n", "hashes", "digest", "sketch"))})
        release_memory()

    found = cut(d.mapInPandas(profile, "doc_id long, n long, hashes binary, digest binary, sketch binary"))
    linked = d.filter(F.col("doc_id").isNotNull())
    whole = found.filter("digest is not null and doc_id is not null")
    copies = whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("hashes").alias("hashes"), F.min("sketch").alias("sketch"))
    # The largest groups of copies are known to every task, which passes over all but one of their texts. Sets whose hashes are equal but
    # for chance are no such group.
    alone = copies.groupBy("hashes").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"), F.count("*").alias("sets")).filter("copies >= 8 and sets = 1")
    hot = {bytes(r["hashes"]): r["rep"] for r in alone.orderBy(F.desc("copies"), "rep").limit(hot_groups).collect()}
    first = hot, bitmap_of(copies.select(F.col("rep").alias("id")), id_bits)
    read = linked.withColumn("spot", spot_of(F.col("doc_id"), id_bits))
    table = frequent_tokens(read, width, buckets, first, 4, table_tokens, bitmap_bits)
    edges = cut(candidate_edges(read, width, buckets, percent, first, table, frequent))
    # Of equal sets, only the smallest id is compared: it has all keys of the others.
    possible = possible_links(edges.filter("listed"), copies.select(F.col("rep").alias("id"), "n", "sketch"), percent)
    candidates = connected_components(edges.filter("not listed").select("u", "v").unionByName(possible))
    groups = cut(candidates.join(copies.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n")), "id").select(F.col("id").alias("doc_id"), "component", "n"))
    edges = verified_edges(linked, groups, width, percent, block_tokens, block_docs, broadcast_rows)
    # Different texts of one id join the groups that they are part of.
    repeated = whole.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")
    if not repeated.isEmpty():
        same = whole.join(repeated, "doc_id").join(copies.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        edges = edges.unionByName(same)
    parts = connected_components(edges)
    reps = copies.join(parts, copies["rep"] == parts["id"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = found.join(reps, "digest", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
