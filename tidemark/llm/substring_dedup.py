"""Substring dedup by relative Lempel-Ziv parsing.

A window of ``width`` words stays at its first place (smallest id, then smallest start); at all others it is a copy. The texts' windows
are the reference: they are dealt to blocks by a hash, and each block is indexed by another one, from a window to the first place where it
stands. Each document is parsed greedily against the index: a factor starts at a copied window and goes on as long as the text goes on in
the same place of its source. The words at both ends of a factor are then compared with those of the source, and the words that the
factors cover are removed; windows are judged on the input, not on what is left.

A task reduces its windows before they are shuffled: each sequence leaves it once, with its first place in the task; its other places
there have that one as their source. So a passage that a third of all documents share puts no load on its block.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_block, cut, release_memory, small_batches, text_bytes
from tidemark.llm.hashing import window_hashes, word_hashes, words_of

#: Two polynomials: the first gives 64 bits, the second chooses the block, which adds its own bits.
BASE, BLOCK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of text for each block and part, so that a task's group stays as large with any number of documents.
BLOCK_BYTES = 8 << 20
#: Windows that a task gathers before it reduces and emits them: about 25 MB.
FLUSH = 1 << 18


def planes(values: np.ndarray) -> bytes:
    """Bytes of the values by significance: the high ones are mostly zero, and Spark's shuffle compresses them away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_runs(doc: np.ndarray, start: np.ndarray, length: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> bytes:
    """Runs of copied windows, sorted by document: their first window, how many, and where the first one stands earlier."""
    return len(doc).to_bytes(8, "little") + b"".join(planes(x) for x in (np.diff(doc, prepend=doc[:1] * 0), start.astype(np.uint32), length.astype(np.uint32), source, source_start.astype(np.uint32)))


def unpack_runs(data: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in (np.int64, np.uint32, np.uint32, np.int64, np.uint32):
        size = n * np.dtype(kind).itemsize
        out.append(from_planes(data[at : at + size], kind).astype(np.int64))
        at += size
    return [np.cumsum(out[0]), *out[1:]]


def joined(doc: np.ndarray, start: np.ndarray, length: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> list[np.ndarray]:
    """Runs sorted by document and start, with those put together that go on in the same document at the same place of one source."""
    if not len(doc):
        return [doc, start, length, source, source_start]
    goes_on = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (start[1:] == start[:-1] + length[:-1]) & (source_start[1:] - source_start[:-1] == start[1:] - start[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return [doc[first], start[first], np.add.reduceat(length, first), source[first], source_start[first]]


def doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part in which a document is put together again."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(BASE)
        return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def copied_runs(docs: DataFrame, width: int, blocks: int, parts: int) -> DataFrame:
    """part, runs: the windows whose sequence starts earlier, with a place where it does, by the part of their document."""

    def by_part(*runs: np.ndarray) -> list[dict]:
        part = doc_part(runs[0], parts)
        order = np.lexsort((runs[1], runs[0], part))
        runs, part = [x[order] for x in runs], part[order]
        at = np.searchsorted(part, np.arange(parts + 1))
        return [{"part": p, "runs": pack_runs(*joined(*(r[x:y] for r in runs)))} for p, (x, y) in enumerate(zip(at, at[1:])) if y > x]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def flush():
            held.sort(key=lambda x: x[0])
            h = np.concatenate([x[1] for x in held])
            block = np.concatenate([x[2] for x in held])
            doc = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
            start = np.concatenate([np.arange(len(x[1])) for x in held])
            order = np.lexsort((h, block))  # stable: the first of equal windows stays first
            same = np.zeros(len(h), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (block[order][1:] == block[order][:-1])
            copy = np.zeros(len(h), bool)
            copy[order] = same
            first = np.empty(len(h), np.int64)
            first[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]
            first = first[copy]
            rows = [{"block": r["part"] % blocks} | r for r in by_part(doc[copy], start[copy], np.ones(len(first), np.int64), doc[first], start[first])]
            h, block, doc, start = h[~copy], block[~copy], doc[~copy], start[~copy]
            order = np.argsort(block, kind="stable")
            h, block, doc, start = h[order], block[order], doc[order], start[order]
            at = np.searchsorted(block, np.arange(blocks + 1))
            rows += [{"block": b, "part": -1, "hashes": h[x:y].tobytes(), "runs": pack_runs(*places_as_runs(doc[x:y], start[x:y]))} for b, (x, y) in enumerate(zip(at, at[1:])) if y > x]
            return pd.DataFrame(rows, columns=["block", "part", "hashes", "runs"])

        for b in batches:
            for i, text in zip(b["doc_id"], b["text"]):
                words = word_hashes(words_of(text, lower=False))
                if len(words) < width:
                    continue
                own = window_hashes(words, width, BASE)
                to = window_hashes(words, width, BLOCK_BASE)
                held.append((i, own, ((to >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)))
                n += len(own)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        held = []
        release_memory()

    def look_up(new: list[tuple]) -> list[dict]:
        """The index of a block: of its windows, those that aren't the first of their sequence, and where the first one stands."""
        h = np.concatenate([np.frombuffer(x[0], np.uint64) for x in new])
        places = [unpack_runs(x[1])[:2] for x in new]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        several = np.zeros(len(h), bool)
        several[1:] |= same
        several[:-1] |= same
        order = order[several]
        h, doc, start = h[order], np.concatenate([p[0] for p in places])[order], np.concatenate([p[1] for p in places])[order]
        order = np.lexsort((start, doc, h))
        h, doc, start = h[order], doc[order], start[order]
        copy = np.zeros(len(h), bool)
        copy[1:] = h[1:] == h[:-1]
        first = np.maximum.accumulate(np.where(copy, 0, np.arange(len(h))))[copy]
        return by_part(doc[copy], start[copy], np.ones(len(first), np.int64), doc[first], start[first])

    def each_block(b: pd.DataFrame) -> pd.DataFrame:
        known = b["part"] >= 0
        rows = look_up(list(zip(b["hashes"][~known], b["runs"][~known]))) if not known.all() else []
        return pd.concat([pd.DataFrame(rows, columns=["part", "runs"]), b.loc[known, ["part", "runs"]]])

    # What is known to be a copy passes through.
    return by_block(docs.mapInPandas(gather, "block int, part int, hashes binary, runs binary"), blocks, "block", each_block, "part int, runs binary")


def places_as_runs(doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Places in the form of runs, without a source."""
    none = np.zeros(len(doc), np.int64)
    return [doc, start, none, none, none]


def furthest(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """Greedily, of the matches that start inside what is covered so far or right behind it, the one that reaches furthest: the fewest that
    cover what all of them do. Matches are sorted by document and start; then their ends ascend too."""
    out: list[int] = []
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
    starts, ends = start.tolist(), end.tolist()
    for a, b in zip(first, [*first[1:], len(doc)]):
        k = int(a)
        while k < b:
            out.append(k)
            k = max(k + 1, bisect.bisect_right(starts, ends[k], k + 1, b) - 1)
    return out


def parse(runs: DataFrame, width: int, parts: int) -> DataFrame:
    """The factors of each document: start, length (in words), source and source_start, greedily: as long as a source goes on,
    and of these matches the ones that reach furthest."""

    def factors(b: pd.DataFrame) -> pd.DataFrame:
        own = [np.concatenate(x) for x in zip(*map(unpack_runs, b["runs"]))]
        order = np.lexsort((own[1], own[0]))
        doc, start, n, source, at = joined(*(x[order] for x in own))
        used = furthest(doc, start, start + n + (width - 1))
        return pd.DataFrame({"part": b["part"].iat[0], "doc": doc[used], "start": start[used], "length": n[used] + (width - 1), "source": source[used], "source_start": at[used]})

    return by_block(runs, parts, "part", factors, "part int, doc long, start long, length long, source long, source_start long")


def with_source_words(factors: DataFrame, docs: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """factors with the words of their sources at both ends, as bytes; null where the source's id has several rows.

    A place of a source is asked for once, however many factors begin or end there. docs: doc_id, text.
    """
    ends = F.explode(F.array("source_start", F.col("source_start") + F.col("length") - width))
    wanted = factors.select("source", ends.alias("at")).distinct()
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("source"))
    if not repeated.isEmpty():
        wanted = wanted.join(repeated, "source", "left_anti")
    # No source has more places than words.
    wanted = cut(wanted.groupBy("source").agg(F.collect_list("at").alias("at")))
    few = wanted.count() <= broadcast_rows and factors.count() <= broadcast_rows

    def words_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, places in zip(b["source"], b["text"], b["at"]):
                words = words_of(text, lower=False)
                rows += [(i, int(p), b" ".join(words[p : p + width])) for p in places]
            yield pd.DataFrame(rows, columns=["source", "at", "words"])
        release_memory()

    # Beyond broadcast_rows all joins are shuffles, whatever Spark's own threshold is, so that small and large tables have the same plan.
    sources = docs.withColumnRenamed("doc_id", "source").join(F.broadcast(wanted) if few else wanted.hint("merge"), "source").select("source", "text", "at")
    found = cut(sources.mapInPandas(words_at, "source long, at long, words binary"))
    for name, at in (("first", F.col("source_start")), ("last", F.col("source_start") + F.col("length") - width)):
        own = found.select(F.col("source").alias("_s"), F.col("at").alias("_at"), F.col("words").alias(name))
        factors = factors.join(F.broadcast(own) if few and found.count() <= broadcast_rows else own.hint("merge"), (F.col("source") == F.col("_s")) & (at == F.col("_at")), "left").drop("_s", "_at")
    return factors


def united(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of words, from and to (exclusive), that factors in ascending order cover."""
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, ends):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20, carry: tuple[str, ...] = (), broadcast_rows: int = 0) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, spans (word ranges removed, end exclusive), factors (those that cover them,
    with their source's id and start), kept (words joined by a space), kept_sha256, and the columns of carry.

    Ids are whole numbers, one for each document: of rows that share an id, a window that any of them has again loses its words in
    all of them. Null texts have no words. Texts of fewer than ``width`` words keep all. Rows with a null id are neither compared nor
    changed. Windows are found by 64 bits of a hash within blocks chosen by another one, and factors whose words differ from their source's
    at an end are dropped (where the source's id has several rows, its words can't be told and hashes decide). Columns of docs that carry doesn't name
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = parts = max(4, -(-text_bytes(docs, text_col) // BLOCK_BYTES))
    own_columns = [f"_c{k}" for k in range(len(carry))]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for c, k in zip(carry, own_columns)))
    carried = "".join(f", {k} {d.schema[k].dataType.simpleString()}" for k in own_columns)
    known = d.select("doc_id", "text").filter("doc_id is not null")
    factors = cut(parse(copied_runs(known, width, blocks, parts), width, parts))
    copies = with_source_words(factors, known, width, broadcast_rows)

    def part_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(part=np.where(b["doc_id"].isna(), b.index % parts, doc_part(b["doc_id"].fillna(0).to_numpy(np.int64), parts)).astype(np.int32))

    texts = d.mapInPandas(part_of, f"doc_id long, text string{carried}, part int")
    schema = f"doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, factors array<struct<start:long,end:long,source:long,source_start:long>>, kept string, kept_sha256 string{carried}"

    def checked(words: list[bytes], found: list[tuple]) -> list[tuple]:
        """Factors whose words at both ends are those of their source."""
        same = lambda at, own: own is None or b" ".join(words[at : at + width]) == own
        return [f for f in found if f[0] + f[1] <= len(words) and same(f[0], f[4]) and same(f[0] + f[1] - width, f[5])]

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A document's factors come first, then its texts, of which only a batch is held."""
        doc, found = None, []
        for b in batches:
            rows, at = [], []
            for n, (i, text, *factor) in enumerate(zip(b["doc_id"], b["text"], b["start"], b["length"], b["source"], b["source_start"], b["first"], b["last"])):
                if pd.isna(i) or i != doc:
                    doc, found = i, []
                if not pd.isna(factor[0]):
                    found.append((*map(int, factor[:4]), *factor[4:]))
                    continue
                words = words_of(text, lower=False)
                own = checked(words, found)
                spans = united([f[0] for f in own], [f[0] + f[1] for f in own])
                kept, done = [], 0
                for first, last in spans:
                    kept += words[done:first]
                    done = last
                kept += words[done:]
                data = b" ".join(kept)
                at.append(n)
                told = [{"start": f[0], "end": f[0] + f[1], "source": f[2], "source_start": f[3]} for f in own]
                rows.append((i, len(words), len(words) - len(kept), [{"start": first, "end": last} for first, last in spans], told, data.decode("utf-8", "surrogatepass"), hashlib.sha256(data).hexdigest()))
            made = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "factors", "kept", "kept_sha256"]).astype({"doc_id": "Int64"})
            yield made.assign(**{k: b[k].to_numpy()[at] for k in own_columns})
        found = []
        release_memory()

    both = texts.unionByName(copies.withColumnRenamed("doc", "doc_id"), allowMissingColumns=True)
    out = both.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", F.col("start").isNull(), "start").mapInPandas(put_together, schema)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "spans", "factors", "kept", "kept_sha256", *(F.col(k).alias(c) for c, k in zip(carry, own_columns)))
