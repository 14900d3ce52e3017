"""Collocations and compacted paths against counts in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def counts(rows, most):
    f = defaultdict(Counter)
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def mined(rows, words, least, share, top):
    out = []
    for lang, f in counts(rows, words).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * c >= share * a for q, c in often.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def some_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "Süd", "new", "york", "city", "x\x1cy", "é", "12", "don't", "\U0001f600", "nbsp word"]
    chain = "we hold these truths to be self evident that all men are created equal"
    out = []
    for _ in range(n):
        parts = [rng.choice([chain, "New York City", " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))]) for _ in range(rng.randint(1, 5))]
        out.append((rng.choice(["en", "en", "en", "fr", None]), rng.choice([" ", ". ", ",", "\n", "\t ", "  ", "\x0b"]).join(parts)))
    return [*out, ("en", None), ("fr", ""), ("de", "one two"), ("en", " .,;\t"), ("xx", "a b " * 3000)]


@pytest.mark.parametrize(("words", "least", "share", "top"), [(3, 10, 50, 2000), (2, 5, 50, 7), (4, 3, 80, 2000), (5, 6, 50, None), (3, 1, 100, 40)])
def test_phrases(spark, words, least, share, top, monkeypatch):
    monkeypatch.setattr(C, "COMMON", 0.02)
    texts = some_texts(words * 10 + least)
    docs = spark.createDataFrame(texts, "lang string, text string").withColumns({c: F.lit("clash") for c in ("node", "next", "salt", "c", "n", "phrase", "rank")})
    got = C.collocations(docs.repartition(5), words=words, least=least, share=share, top=top)
    assert rows_of(got) == mined(texts, words, least, share, top)


def test_a_flush_at_every_text(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH", 1)
    texts = some_texts(3, 40)
    assert rows_of(C.collocations(spark.createDataFrame(texts, "lang string, text string"))) == mined(texts, 3, 10, 50, 2000)


@pytest.mark.parametrize("words", [2, 3, 4])
def test_paths(spark, words):
    """Paths tell the edges, each once, and have no inner node that another edge enters or leaves."""
    texts = some_texts(8)
    got = C.collocations(spark.createDataFrame(texts, "lang string, text string"), words=words, least=5, paths=True).collect()
    edges, f = Counter(), counts(texts, words)
    for r in got:
        path = r["path"]
        edges.update((r["lang"], tuple(path[i : i + words]), r["c"]) for i in range(len(path) - words + 1))
        assert all(f[r["lang"]][tuple(path[i : i + words - 1])] == r["c"] for i in range(1, len(path) - words + 1))
    want = {(lang, p, c) for lang, own in f.items() for p, c in own.items() if len(p) == words and c >= 5}
    assert set(edges) == want and max(edges.values()) == 1
    assert max(len(r["path"]) for r in got) >= 14 - (words > 2)  # the chain of fourteen words


def test_products_beyond_64_bits(spark):
    # 9e9 squared times a million has 26 digits.
    counts = spark.createDataFrame([("x", 9_000_000_007)], "t string, a long")
    whole = "cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))"
    got = counts.select(F.expr(f"({whole}) div (cast(a + 1 as decimal(19,0)) * cast(a + 2 as decimal(19,0)))")).first()[0]
    assert got == 1000000 * 9_000_000_007**2 // (9_000_000_008 * 9_000_000_009)


def test_no_texts(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(docs).count() == 0 and C.collocations(docs, paths=True).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_codes_that_pass_62_bits():
    import numpy as np

    counter = C.Counter(3)
    counter.add("en", "a b c d a b c. a b")
    size = 1 << 40  # as if so many words were known
    codes, last = np.array([1 << 30, 5, 1 << 30]), np.array([7, 7, 8])
    joined = counter.joined(codes, last, size)
    assert len(set(joined.tolist())) == 3 and joined.max() < 1 << 62


def test_both_aggregates_share_one_exchange(spark, sf, monkeypatch):
    seen = []
    own = C.cut

    def cut(df):
        seen.append(df)
        return own(df)

    monkeypatch.setattr(C, "cut", cut)
    C.counted(spark.read.parquet(f"{sf}/documents.parquet"), 3, 10, "lang", "text")
    both = seen[1]
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()
