"""Vectors, URLs, components and the pipeline."""

import math

import numpy as np
import pytest
from conftest import BASE

from tidemark.llm import components, url_filter, vector_dedup


def linked(rows, least=0.93):
    """id: (links, smallest id reachable), by comparing all pairs."""
    ok = {i: (np.array(v, float), k) for i, v, k in rows if i is not None and v and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    n, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    ids = sorted(ok)
    pairs = [(a, b) for a in ids for b in ids if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.sqrt((ok[a][0] ** 2).sum() * (ok[b][0] ** 2).sum()) >= least]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (n[i], root[i]) for i in n}


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "beam": 2}])
def test_vectors(spark, options):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(3):
        centers = rng.normal(size=(12, 8))
        for i in range(60):
            rows.append((100 * k + i, [float(np.float32(x)) for x in centers[i % 12] + rng.normal(size=8) * 0.12], k))
    rows += [(900 + i, rows[0][1], 0) for i in range(5)] + [(950, rows[0][1], None), (951, None, 0), (952, [], 0), (953, [0.0] * 8, 0), (954, [1.0, None] * 4, 0), (955, [float("nan")] * 8, 0), (956, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n", "2 as rep", "3 as size")
    got = vector_dedup.link_vectors(df, **options).collect()
    want = linked(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    total = sum(x for x, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)  # none below the threshold
    assert sum(r["n_links"] for r in got) >= 0.95 * total
    if not options:
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_vectors_of_any_length_link(spark):
    """Parallel vectors near the ends of the doubles' range, whose squares are none."""
    rows = [(i, [c * x for x in (1.0, 2.0, -1.0)], 1) for i, c in enumerate((1.0, 3.0, 0.5, 1e-200, 1e200, 5e-324, 8e307))]
    rows.append((9, [0.0, 0.0, 0.0], 1))
    got = vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, 6, 0) for i in range(7)] + [(9, 0, 9)]


def test_no_vectors(spark):
    assert vector_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_small_world_recall():
    rng = np.random.default_rng(0)
    x = vector_dedup.unit(np.concatenate([rng.normal(size=(400, 16)), np.repeat(rng.normal(size=(1, 16)), 300, axis=0) + rng.normal(size=(300, 16)) * 0.05]))
    graph = vector_dedup.SmallWorld(x)
    truth = x @ x.T >= 0.93
    found = sum(len(vector_dedup.exact(graph.within(x[i], 0.93, 16), x, x[i], 0.93)) for i in range(len(x)))
    assert found >= 0.97 * truth.sum()


@pytest.mark.parametrize("linked_queries", [2, 300])
def test_links_that_a_graph_misses_are_found(linked_queries):
    """The audit counts no matches with oneself, goes on where it saw no link, and gives way to all pairs where the widest beam fails."""

    class Blind:
        def __init__(self, x):
            self.x = x

        def within(self, q, least, beam):
            return np.flatnonzero(self.x @ q > 1 - 1e-9)  # the query itself

    rng = np.random.default_rng(8)
    own = rng.normal(size=(600, 24))
    own[600 - linked_queries :: 2] = own[601 - linked_queries :: 2] + 0.01
    x, ids = vector_dedup.unit(own), np.arange(600)
    got = vector_dedup.links_found(Blind(x), x, ids, x, ids, 0.93, 16, 48, 0.98, 64)
    assert [set(f) - {k} for k, f in enumerate(got)] == [set(np.flatnonzero(s >= 0.93)) - {k} for k, s in enumerate(x @ x.T)]


def test_links_from_another_shard_are_found():
    """Of 900 queries of another shard two have a link; a graph that finds nothing loses neither."""

    class Empty:
        def within(self, q, least, beam):
            return np.zeros(0, np.int64)

    rng = np.random.default_rng(9)
    x = vector_dedup.unit(rng.normal(size=(500, 24)))
    q = vector_dedup.unit(rng.normal(size=(900, 24)))
    q[[7, 611]] = vector_dedup.unit(x[[3, 4]] + 0.001)
    got = list(vector_dedup.links_found(Empty(), x, np.arange(500), q, np.arange(1000, 1900), 0.93, 16, 48, 0.98, 64))
    assert [(k, f.tolist()) for k, f in enumerate(got) if len(f)] == [(7, [3]), (611, [4])]


URLS = [
    (1, "http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://EXAMPLE.org/en/12?x=/y", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "https://b.org/en/1#/z", "b.org", "/en/1", "org/", "allow"),
    (4, "http://b.org?x", "b.org", "", None, None),
    (5, "http://xcom/fr/1", "xcom", "/fr/1", None, None),
    (6, "http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    (7, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    (8, "no scheme/fr/", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "", "", "", None, None),
    (11, "http://x.com/a://b.org/es/", "x.com", "/a://b.org/es/", None, None),
    (11, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    (None, "http://x.org/", "x.org", "/", "org/", "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string").selectExpr("*", "'clash' as host", "'clash' as rule", "'clash' as kind")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in url_filter.filter_urls(df).collect()), key=str)
    assert got == sorted(((i, h, p, r) for i, _, h, p, r, _ in URLS), key=str)
    verdicts = url_filter.filter_urls(df).collect()
    assert all(r["verdict"] in ("allow", "block") for r in verdicts)
    assert url_filter.filter_urls(df.filter("false")).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df.filter("page_id in (8, 9)")).collect()} == {"allow"}


def test_url_models_tell_unseen_urls_apart(spark):
    rows = [(i, f"http://s{i}.com/de/pills-cheap-{i}") for i in range(200)] + [(1000 + i, f"http://s{i}.com/fr/library-books-{i}") for i in range(200)] + [(5000, "http://q.net/en/pills-cheap-9"), (5001, "http://q.net/en/library-books-9")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[5000]["verdict"], got[5001]["verdict"]) == ("block", "allow")


def by_brute_force(urls, kinds, order=5, least=4):
    """The difference of a URL by the models of the other ones, from counts in memory."""
    n = ({}, {})
    for u, k in zip(urls, kinds):
        s = url_filter.START + u + url_filter.END
        for i in range(1, len(s)):
            for m in range(min(order, i) + 1):
                own = n[k].setdefault(s[i - m : i], {})
                own[s[i]] = own.get(s[i], 0) + 1
    alphabet = len({c for x in n for c in x[""]}) + 1

    def likelihood(k, u):
        s, total = url_filter.START + u + url_filter.END, 0.0
        for i in range(1, len(s)):
            p = 1 / alphabet
            for m in range(min(order, i) + 1):
                own = n[k].get(s[i - m : i], {})
                if sum(own.values()) < least:
                    break
                p = (own.get(s[i], 0) + len(own) * p) / (sum(own.values()) + len(own))
            total += math.log(p)
        return total

    return lambda u: (likelihood(1, u) - likelihood(0, u)) / (len(u) + 1)


def test_rare_url_contexts_count_in_large_tables(spark):
    common, rare = "https://shop.com/de/" + "0123456789" * 20, "https://shop.com/de/zqxjkv"
    urls = [common] * 6000 + [rare] * 5 + ["https://shop.com/fr/abc"] * 50
    kinds = [1] * 6005 + [0] * 50
    model = url_filter.fit_url_model(spark.createDataFrame(list(zip(urls, kinds)), "url string, kind int"))
    asked = ["https://new.net/zqxjkv", "https://new.net/abc", "", "http://\u00e9t\u00e9.net/0123"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*asked, None])], "n long, url string")
    got = {r["n"]: r["_difference"] for r in url_filter.difference(df, model).collect()}
    brute = by_brute_force(urls, kinds)
    assert got == pytest.approx({i: brute(u) for i, u in enumerate(asked)} | {4: 0.0})


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)] + [(None, 5)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in root:
        for a, b in edges:
            if a is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["id"]: r["component"] for r in got.collect()} == root
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies_stage_groups_no_documents_by_passages_of_a_few(spark, monkeypatch, sf):
    """Twenty texts share each passage, which a full bitmap can't tell from words of their own; two are near copies."""
    import corpus_pipeline
    from tidemark.llm import jaccard_join

    options, seen, components, verify = {"bitmap_bits": 4, "table_tokens": 0}, [], jaccard_join.jaccard_components, jaccard_join.verified_edges
    monkeypatch.setattr(corpus_pipeline, "jaccard_components", lambda docs: components(docs, **options))
    monkeypatch.setattr(jaccard_join, "verified_edges", lambda docs, groups, *a: seen.append(sorted(r["doc_id"] for r in groups.collect())) or verify(docs, groups, *a))
    texts = [" ".join([*(f"p{i // 20}_{k}" for k in range(12)), *(f"w{i}_{k}" for k in range(40)), *(f"p{(i + 10) // 20}x_{k}" for k in range(12))]) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (99, texts[7] + " tail")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == list(range(60))
    assert seen == [[7, 99]]


def brute_pipeline(rows, items, rejected):
    """ids and word counts that the pipeline keeps, by comparing everything with everything."""
    from test_text_operators import holding, similar

    kept = [(i, t) for i, t in rows if i not in rejected]
    groups = similar(kept)
    kept = sorted((i, t) for i, t in kept if groups[i][1] == i)
    seen, cut = set(), []
    for i, t in kept:
        w = t.split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        if not any(gone):
            cut.append((i, t))
        elif not all(gone):
            cut.append((i, " ".join(x for x, g in zip(w, gone) if not g)))
    bad = {i for i, _ in holding(cut, items)}
    return {i: len(t.split()) + 1 for i, t in cut if i not in bad}


def test_pipeline(spark, sf, tmp_path, texts):
    import corpus_pipeline
    from pyspark.sql import functions as F

    out = corpus_pipeline.run(spark, sf)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns
    rejected = set(texts) - {r["doc_id"] for r in first.select("doc_id").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert len(rejected) <= 0.02 * len(texts)
    assert got == brute_pipeline([(i, t) for i, t in texts.items()], items, rejected)


def test_stages_take_odd_rows(spark, sf, odd):
    import corpus_pipeline

    docs = odd.unionByName(odd.filter("doc_id = 5"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out
        assert stage(spark, odd.filter("false"), sf).count() == 0
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept[5] == BASE and 6 not in kept and 1 not in kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
