"""Language identification by word-first backoff.

A word that the model knows adds its log frequency in each language. For a word that it doesn't know, each character position adds the
log frequency of the longest known n-gram that starts there (n = max_n down to 1), averaged over the word's positions.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from xxhash import xxh3_64_intdigest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import each_text, release_memory, schema_and, small_batches
from tidemark.llm.hashing import mix

#: Letters with the marks that combine with them; a word has a letter.
WORDS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
BASE = np.uint64(0x9E3779B97F4A7C15)
PLAIN = re.compile("[a-z]+")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return PLAIN.findall(text) if text.isascii() else WORDS.findall(text)


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, map(str.encode, words)), np.uint64, len(words))


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def gram_hashes(c: np.ndarray, m: int) -> np.ndarray:
    """A hash of each m-gram of characters along the last axis."""
    with np.errstate(over="ignore"):
        h = np.zeros_like(c[..., : c.shape[-1] - m + 1])
        for j in range(m):
            h = h * BASE + c[..., j : c.shape[-1] - m + 1 + j] + np.uint64(1)
        return mix(h)


def hashes_of_grams(grams: list[str]) -> np.ndarray:
    length, out = np.array([len(g) for g in grams]), np.zeros(len(grams), np.uint64)
    for m in set(length.tolist()):
        at = np.flatnonzero(length == m)
        out[at] = gram_hashes(characters("".join([grams[k] for k in at.tolist()])).reshape(len(at), m), m)[:, 0]
    return out


@dataclass
class Table:
    """Log frequencies by language of words or n-grams: key k, a hash, has the entries at[k] to at[k + 1] of language and gain.

    A language without an entry has its floor, the log frequency of what it lacks; gain is what an entry lies above that.
    """

    keys: np.ndarray
    at: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[k] == h, k, -1)

    def add(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The rows' weighted log frequencies, summed for each language."""
        n = self.at[rows + 1] - self.at[rows]
        own = np.repeat(self.at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return weights.sum() * self.floor + np.bincount(self.language[own], self.gain[own] * np.repeat(weights, n), len(self.floor))


@dataclass
class LanguageModel:
    languages: list[str]
    words: Table
    grams: Table
    max_n: int


def word_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, word, n over docs, counted in each batch before it is shuffled."""

    def count(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                n = Counter()
                for t in texts:
                    n.update(words_of(t))
                if n:
                    yield pd.DataFrame({"lang": [lang] * len(n), "word": list(n), "n": list(n.values())})
        release_memory()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def log_table(counts: DataFrame, key: str, languages: list[str], hashes) -> Table:
    """The table of counts (lang, key, n): as many entries as the sample has, its strings as hashes."""
    hashed = counts.mapInPandas(lambda batches: (pd.DataFrame({"lang": b["lang"], "h": hashes(b[key].tolist()).view(np.int64), "n": b["n"]}) for b in batches), "lang string, h long, n long")
    found = hashed.toArrow()
    column = {x: i for i, x in enumerate(languages)}
    language = np.array([column[x] for x in found.column("lang").to_pylist()], np.int64)
    h, n = np.array(found.column("h").to_numpy()).view(np.uint64), found.column("n").to_numpy().astype(np.float64)
    order = np.lexsort((language, h))
    h, language, n = h[order], language[order], n[order]
    keys, at = np.unique(h, return_index=True)
    total = np.log(np.bincount(language, n, len(languages)) + 0.5 * max(1, len(keys)))
    floor = np.log(0.5) - total
    return Table(keys, np.append(at, len(h)).astype(np.int64), language.astype(np.uint16), (np.log(n + 0.5) - np.log(0.5)).astype(np.float32), floor)


def fit_language_model(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", max_train_docs: int = 20_000, max_n: int = 4) -> LanguageModel:
    """Fits on the rows of docs with a language and a text.

    Above max_train_docs such rows, a sample by a hash of the id holds about so many, which bounds the model that each executor gets:
    all languages, words and n-grams of the sample's whole texts are in it. Repeated rows count as often as they stand; an empty table
    gives a model without languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = max_train_docs / max(1, rows.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = word_counts(rows, lang_col, text_col).persist()

    def pieces(batches):
        for b in batches:
            n = Counter()
            for lang, word, c in zip(b["lang"], b["word"], b["n"]):
                w = f"<{word}>"
                for m in range(1, max_n + 1):
                    for i in range(len(w) - m + 1):
                        n[lang, w[i : i + m]] += c
            if n:
                yield pd.DataFrame({"lang": [k[0] for k in n], "gram": [k[1] for k in n], "n": list(n.values())})
        release_memory()

    grams = counts.mapInPandas(pieces, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    model = LanguageModel(languages, log_table(counts, "word", languages, hashes), log_table(grams, "gram", languages, hashes_of_grams), max_n)
    counts.unpersist()
    return model


def backoff(model: LanguageModel, words: list[str], weights: list[int]) -> np.ndarray:
    """What unknown words add: for each position the longest known n-gram that starts there, averaged over a word's positions."""
    c = characters("".join([f"<{w}>" for w in words]))
    of = np.cumsum(c == ord("<")) - 1
    end = np.append(np.flatnonzero(c == ord("<"))[1:], len(c))[of]  # of the word at each position
    rows = np.full(len(c), -1)
    for m in range(1, model.max_n + 1):
        inside = np.flatnonzero(np.arange(len(c)) + m <= end)
        found = model.grams.find(gram_hashes(c, m)[inside])
        rows[inside[found >= 0]] = found[found >= 0]
    first = np.flatnonzero(rows >= 0)
    n = np.bincount(of[first], minlength=len(words))
    return model.grams.add(rows[first], (np.asarray(weights, np.float64) / np.maximum(n, 1))[of[first]])


def scores(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """The language of a text and the model's share of belief in it; ("und", 0.0) without letters or languages."""
    found = Counter(words_of(text)) if text else None
    if not found or not model.languages:
        return "und", 0.0
    words, n = list(found), np.fromiter(found.values(), np.float64)
    rows, total = model.words.find(hashes(words)), n.sum()
    known = rows >= 0
    ll = model.words.add(rows[known], n[known])
    unknown = np.flatnonzero(~known).tolist()
    for at in range(0, len(unknown), 4_096):
        some = unknown[at : at + 4_096]
        ll = ll + backoff(model, [words[k] for k in some], n[some])
    # Words of a text aren't independent: the mean counts as 12 words at most.
    p = ll / total * min(total, 12)
    p = np.exp(p - p.max())
    best = int(p.argmax())  # of equal ones the first by name
    return model.languages[best], float(p[best] / p.sum())


def identify_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1), from whole texts, however long they are.

    ``und`` and 0 for null texts and texts without letters (Unicode's category L). Of equally likely languages the first by name wins.
    Columns of docs of these two names are replaced; all others stay, and each row, repeated or not, gets its own result. An empty
    table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_and(rows, lang_pred="string", score="double")

    def predict(batches):
        import pyarrow as pa

        for b in batches:
            found = [scores(shared.value, t) for t in each_text(b, text_col)]
            yield b.append_column("lang_pred", pa.array([x[0] for x in found], pa.string())).append_column("score", pa.array([x[1] for x in found], pa.float64()))
        release_memory()

    return rows.mapInArrow(predict, schema)
