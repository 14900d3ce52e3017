"""Toxicity by a factorization machine over hashed terms.

A document's features are its distinct terms: words, and the first five letters of longer words, hashed to buckets. The score is
sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)), so that pairs of terms weigh in besides the single ones.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import each_text, release_memory, schema_and, small_batches

WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class FactorizationMachine:
    """w and v by bucket; both are zero where training saw no term."""

    w0: float
    w: np.ndarray
    v: np.ndarray


def buckets(text: str | None, dimension: int, cache: dict[str, tuple]) -> np.ndarray:
    """The distinct hashed terms of a text, ascending."""
    found: set[int] = set()
    for word in set(WORDS.findall(text.lower())) if text else ():
        got = cache.get(word)
        if got is None:
            if len(cache) > 300_000:
                cache.clear()
            got = (zlib.crc32(word.encode()) % dimension,) + ((zlib.crc32(b"^" + word[:5].encode()) % dimension,) if len(word) > 5 else ())
            cache[word] = got
        found.update(got)
    return np.array(sorted(found), dtype=np.int64)


def fit_factorization_machine(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", dimension: int = 1 << 18, max_train_rows: int = 6_000, factors: int = 6, epochs: int = 40, rate: float = 0.02, positive_weight: float = 3.0, l2: float = 1e-5, seed: int = 7) -> FactorizationMachine:
    """Fits on the rows of labelled whose label is 0 or 1.

    Above max_train_rows, a sample by a hash of the id holds about so many, which bounds what the driver gets. All terms of these rows'
    whole texts are trained, by themselves and in pairs: those whose share differs little between the classes only move more slowly, as
    evidence() says. A row of class 1 weighs positive_weight. Null texts have no terms; repeated rows count as often as they stand.
    Without rows of both classes, or any at all, every score is the base rate.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
    share = max_train_rows / max(1, rows.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def hashed(batches):
        cache: dict = {}
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "terms": [buckets(t, dimension, cache) for t in b["text"]]})
        cache.clear()
        release_memory()

    data = rows.mapInPandas(hashed, "y int, terms array<int>").toPandas()
    lists = [np.asarray(t, dtype=np.int64) for t in data["terms"]]
    y = data["y"].to_numpy(dtype=np.float64)
    # The order of tasks doesn't matter.
    order = sorted(range(len(lists)), key=lambda i: (y[i], zlib.crc32(lists[i].tobytes()), len(lists[i])))
    lists, y = [lists[i] for i in order], y[order]
    n1, n0 = y.sum(), len(y) - y.sum()
    base = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    w, v = np.zeros(dimension, np.float32), np.zeros((dimension, factors), np.float32)
    if not n0 or not n1:
        return FactorizationMachine(base, w, v)
    terms, at = np.unique(np.concatenate(lists), return_inverse=True)
    lists = np.split(at, np.cumsum([len(x) for x in lists])[:-1])
    w0, w[terms], v[terms] = _train(lists, y, len(terms), base, factors, epochs, rate, positive_weight, l2, seed)
    return FactorizationMachine(w0, w, v)


def evidence(lists: list[np.ndarray], y: np.ndarray, terms: int) -> np.ndarray:
    """How fast each term moves, above 0 to 1: |z| of its shares in the two classes (two-proportion, 1 at least) over the largest."""
    n = np.bincount(np.concatenate(lists), minlength=terms)
    n1 = np.bincount(np.concatenate([x for x, t in zip(lists, y) if t]), minlength=terms)
    rows1, rows0, p = y.sum(), len(y) - y.sum(), n / len(y)
    z = np.abs(n1 / rows1 - (n - n1) / rows0) / np.sqrt(p * (1 - p) * (1 / rows0 + 1 / rows1) + 1e-9)
    return (np.maximum(z, 1) / max(z.max(), 1)).astype(np.float32)


def _train(lists: list[np.ndarray], y: np.ndarray, terms: int, base: float, factors: int, epochs: int, rate: float, positive_weight: float, l2: float, seed: int):
    """Adam over shuffled batches of the logistic loss; a term's weights are its parameters times its evidence."""
    rng = np.random.default_rng(seed)
    speed = evidence(lists, y, terms) if sum(map(len, lists)) else np.ones(terms, np.float32)
    theta = {"w0": np.array([base], np.float32), "w": np.zeros(terms, np.float32), "v": rng.normal(0, 0.02, (terms, factors)).astype(np.float32)}
    m, s = ({k: np.zeros_like(x) for k, x in theta.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            idx, doc = np.concatenate([lists[i] for i in rows]), np.repeat(np.arange(len(rows)), [len(lists[i]) for i in rows])
            v = theta["v"][idx] * speed[idx, None]
            sums = np.stack([np.bincount(doc, v[:, f], len(rows)) for f in range(factors)], axis=1)
            raw = theta["w0"][0] + np.bincount(doc, theta["w"][idx] * speed[idx], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (v**2).sum(1), len(rows)))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * np.where(y[rows] > 0, positive_weight, 1) / len(rows)
            gv = g[doc, None] * (sums[doc] - v)
            grad = {"w0": np.array([g.sum()]), "w": np.bincount(idx, g[doc], terms) * speed, "v": np.stack([np.bincount(idx, gv[:, f], terms) for f in range(factors)], axis=1) * speed[:, None]}
            step += 1
            for k, x in theta.items():
                d = (grad[k] + (l2 * x if k != "w0" else 0)).astype(np.float32)
                m[k] += np.float32(0.1) * (d - m[k])
                s[k] += np.float32(0.001) * (d * d - s[k])
                x -= np.float32(rate / (1 - 0.9**step)) * m[k] / (np.sqrt(s[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return float(theta["w0"][0]), theta["w"] * speed, theta["v"] * speed[:, None]


def score(model: FactorizationMachine, terms: np.ndarray) -> float:
    v = model.v[terms].astype(np.float64)
    raw = model.w0 + model.w[terms].sum(dtype=np.float64) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
    return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5), from whole texts, however long; null and empty texts have the base score.

    Columns of docs of these two names are replaced; all others stay, and each row, repeated or not, gets its own result. An empty
    table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dimension = len(model.w)
    schema = schema_and(rows, score="double", predicted="int")

    def predict(batches):
        import pyarrow as pa

        cache: dict = {}
        for b in batches:
            found = [score(shared.value, buckets(t, dimension, cache)) for t in each_text(b, text_col)]
            yield b.append_column("score", pa.array(found, pa.float64())).append_column("predicted", pa.array([int(x >= 0.5) for x in found], pa.int32()))
        cache.clear()
        release_memory()

    return rows.mapInArrow(predict, schema)
