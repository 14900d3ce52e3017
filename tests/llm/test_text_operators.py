"""Operators on texts against brute force, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import BASE, LONG, ODD
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, language_id, license_scan, packing, substring_dedup, token_files, toxicity

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def licenses(text):
    words = LICENSE_WORD.findall(lower(text))
    places = [(i, label) for phrase, label in license_scan.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def check_licenses(docs, texts):
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == len(texts)
    found = sorted(((r["doc_id"] or 0, (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got), key=str)
    assert found == sorted(((i or 0, licenses(t)) for i, t in texts), key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_licenses(documents, texts):
    check_licenses(documents, list(texts.items()))


def test_licenses_in_odd_texts(spark, odd, nothing):
    check_licenses(odd, ODD)
    more = [(1, "MIT License mit license, CC-BY 4.0; CC by"), (2, "apache  license"), (2, "apache  license"), (3, "mit licenses"), (4, "Licensed under the brand new Apache License, version 2.0 of today")]
    df = spark.createDataFrame(more, "doc_id long, text string")
    check_licenses(df, more)
    assert "apache-2.0" in [r["labels"] for r in license_scan.scan_licenses(df).filter("doc_id = 4").collect()][0].split(",")
    assert license_scan.scan_licenses(nothing).count() == 0


def test_spans_need_the_words_that_tell_a_license_apart(spark):
    texts = {
        1: ("Eclipse Public License, version 2.0", ""),
        2: ("GNU General Public License version 2.0", "gpl"),
        3: ("Mozilla Public License, version 2.0", "mpl-2.0"),
        4: ("the Mozilla Foundation Public License version 2.0", "mpl-2.0"),
        5: ("Licensed under the Apache License, version 1.1", "apache"),
        6: ("x y z mozilla public license public license version", ""),
    }
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {i: label for i, (_, label) in texts.items()}
    assert got[1]["score"] == 0.0 and got[3]["score"] == 1.0 and got[4]["score"] == 0.75


def test_long_templates_fill_several_masks(spark):
    text = " ".join(f"w{i}" for i in range(150))
    df = spark.createDataFrame([(1, text), (2, " ".join(text.split()[:75]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(df, long=[(text, "long")]).collect()}
    assert got == {1: ("long", 1.0), 2: ("", 73 / 148)}


def test_languages_of_odd_texts(documents, odd, nothing):
    model = language_id.fit_language_model(documents.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in language_id.identify_language(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5]["lang_pred"] == got[6]["lang_pred"] and got[5]["n_words"] == "clash"
    assert language_id.identify_language(nothing, model).count() == 0
    empty = language_id.fit_language_model(nothing)
    assert {r["lang_pred"] for r in language_id.identify_language(odd, empty).collect()} == {"und"}


def test_letters_are_those_of_unicode(spark):
    rows = [(1, "½ ² Ⅷ ① 12_3"), (2, "cafe\u0301 cafe\u0301"), (3, "\u0301 7"), (3, "der Garten"), (3, "der Garten")]
    model = language_id.fit_language_model(spark.createDataFrame([(1, "cafe\u0301", "fr"), (2, "der Garten", "de"), (2, "der Garten", "de")], "doc_id long, text string, lang string"))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert got == [(1, "und"), (2, "fr"), (3, "de"), (3, "de"), (3, "und")]
    assert language_id.WORDS.findall("cafe\u0301 x") == ["cafe\u0301", "x"]


def by_tables(rows, text, max_n=4):
    """Log likelihoods by language, word by word and position by position."""
    words, grams = {}, {}
    for _, t, lang in rows:
        for w in language_id.WORDS.findall(t.lower()):
            words.setdefault(w, {}).setdefault(lang, 0)
            words[w][lang] += 1
            g = f"<{w}>"
            for m in range(1, max_n + 1):
                for i in range(len(g) - m + 1):
                    grams.setdefault(g[i : i + m], {}).setdefault(lang, 0)
                    grams[g[i : i + m]][lang] += 1
    langs = sorted({lang for *_, lang in rows})

    def log(table, key, lang):
        return np.log((table[key].get(lang, 0) + 0.5) / (sum(x.get(lang, 0) for x in table.values()) + 0.5 * len(table)))

    out = dict.fromkeys(langs, 0.0)
    found = language_id.WORDS.findall(text.lower())
    for w in found:
        g = f"<{w}>"
        longest = [next((g[i : i + m] for m in range(min(max_n, len(g) - i), 0, -1) if g[i : i + m] in grams), None) for i in range(len(g))]
        longest = [x for x in longest if x]
        for lang in langs:
            out[lang] += log(words, w, lang) if w in words else np.mean([log(grams, x, lang) for x in longest]) if longest else 0.0
    p = np.array([out[x] for x in langs]) / len(found) * min(len(found), 12)
    p = np.exp(p - p.max())
    return langs[int(p.argmax())], float(p.max() / p.sum())


def test_languages_by_brute_force(spark):
    rows = [(1, "der die das katze mauer", "de"), (2, "the cat wall garden die", "en"), (3, "le chat mur jardin cat", "fr"), (4, "the the das", "en")]
    model = language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in ("die katzen", "the gardens of walls", "chats murs", "cat", "zzz qqq", "Der Kater, das Dach 12"):
        want, got = by_tables(rows, text), language_id.scores(model, text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-5


def test_unseen_words_fall_back_to_grams(spark):
    rows = [(i, "der die das katze mauer garten schauen", "de") for i in range(5)] + [(i + 9, "the cat wall garden looking thing", "en") for i in range(5)]
    model = language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (model.words.find(language_id.hashes(["looked", "cat"])) >= 0).tolist() == [False, True]
    assert language_id.scores(model, "thinglooking wallthing")[0] == "en" and language_id.scores(model, "gartenmauer katzenschauen")[0] == "de"


def test_toxicity_finds_pairs_that_single_terms_miss(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        words = [f"w{k}" for k in rng.integers(0, 50, 6)] + ["insult"] * int(a) + ["group"] * int(b)
        rows.append((i, " ".join(words), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_factorization_machine(df)
    by = {t: toxicity.score(model, toxicity.buckets(t, len(model.w), {})) for t in ("insult", "group", "insult group", "w1")}
    assert by["insult group"] > 0.5 > max(by["insult"], by["group"], by["w1"])


def test_toxicity_finds_pairs_whose_terms_have_no_effect_alone(spark):
    """One of two words is toxic, both or none are not: neither word's share differs between the classes."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join([f"w{k}" for k in rng.integers(0, 50, 6)] + ["insult"] * int(a) + ["group"] * int(b)), int(a != b)))
    train = spark.createDataFrame(rows[:2400] * 2, "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(spark.createDataFrame(rows[2400:], "doc_id long, text string, toxic int"), toxicity.fit_factorization_machine(train, positive_weight=1.0))
    assert got.filter("predicted = toxic").count() >= 0.95 * 600


def test_toxicity_of_odd_texts(spark, odd, nothing):
    labelled = spark.createDataFrame([(1, "fine words", 0), (2, None, 1), (3, "other", None)], "doc_id long, text string, toxic int")
    for train in (labelled, labelled.filter("toxic = 0"), labelled.filter("false")):
        got = toxicity.score_toxicity(odd, toxicity.fit_factorization_machine(train)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score_toxicity(nothing, toxicity.fit_factorization_machine(labelled)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(texts):
    """id: (shingles, smallest id reachable), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts if i is not None}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def check_similar(docs, texts, **options):
    got = jaccard_join.jaccard_components(docs, **options).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == similar(texts)


def test_similar_documents(documents, texts):
    check_similar(documents, list(texts.items()))


def test_similar_odd_documents(odd, nothing):
    check_similar(odd, ODD)
    assert jaccard_join.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("options", [{"frequent": 3}, {"frequent": 3, "block_docs": 7}, {"broadcast_rows": 0, "table_tokens": 5, "bitmap_bits": 12}])
def test_similar_documents_with_frequent_tokens_and_small_blocks(spark, options):
    """Large groups of near copies and shared passages, with the bounds set so low that every path runs."""
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = [f"a{k}" for k in range(60)]
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            words[k] = f"x{rng.integers(0, 999)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*shared, *(f"u{i}_{k}" for k in range(rng.integers(5, 25)))])) for i in range(40)]
    rows += [(200 + i, f"p{i % 3} q r") for i in range(6)]
    check_similar(spark.createDataFrame(rows, "doc_id long, text string"), rows, **options)


def test_rows_that_share_an_id_are_one_document(spark):
    """B links with 1 and C with 3; both stand under id 5, so that all are one group, and so do the ids that it brings together."""
    b, c = " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    rows = [(1, b), (3, c), (5, b), (5, c), (7, c + " tail"), (8, "alone " * 9), (8, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (3, 1), (5, 1), (5, 1), (7, 1), (8, 8), (8, 8)]


def similar_sets(rng, n):
    """Two sets of about n hashes that are about as similar as they have to be."""
    shared = rng.integers(0, 1 << 63, n).astype(np.uint64)
    own = rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1)).astype(np.uint64)
    at = rng.integers(0, len(own) + 1)
    return np.unique(np.concatenate([shared, own[:at]])), np.unique(np.concatenate([shared, own[at:]]))


@pytest.mark.parametrize("percent", [75, 40])
def test_similar_sets_have_a_key_in_common_and_sketches_that_allow_it(percent):
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(1500):
        a, b = similar_sets(rng, int(rng.choice([1, 2, 3, 5, 9, 15, 16, 33, 90, 400])))
        if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        seen += 1
        several = int(rng.integers(1, 50))
        keys = [jaccard_join.prefix_keys(s, 1 + (s >> np.uint64(7)).astype(np.int64) % several, percent, 10) for s in (a, b)]
        assert len(np.intersect1d(*keys))
        assert jaccard_join.may_link(len(a), jaccard_join.sketch(a), len(b), jaccard_join.sketch(b), percent)
    assert seen > 700


def test_sketches_of_sets_without_common_tokens_allow_no_link():
    rng = np.random.default_rng(4)
    for n, m in ((40, 40), (40, 50), (600, 500), (5000, 4000)):
        a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, m))
        assert not jaccard_join.may_link(n, jaccard_join.sketch(a), m, jaccard_join.sketch(b), 75)


@pytest.mark.parametrize("n", [20, 300, 2_000, 20_000])
def test_keys_of_frequent_tokens_grow_no_faster_than_the_set(n):
    s = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    assert len(jaccard_join.prefix_keys(s, np.full(len(s), 999), 75, 256)) < 2 * n


def candidates_of(monkeypatch, docs, **options):
    """Edges of candidates and groups that are verified, of a run over docs."""
    seen = {}
    for name, at in (("connected_components", 0), ("verified_edges", 1)):

        def watch(*args, own=getattr(jaccard_join, name), name=name, at=at, **more):
            seen.setdefault(name, args[at].count())
            return own(*args, **more)

        monkeypatch.setattr(jaccard_join, name, watch)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, **options).collect()}
    return seen["connected_components"], seen["verified_edges"], found


def test_keys_shared_by_chance_tie_no_groups_and_copies_are_indexed_once(spark, monkeypatch):
    """Each text has a passage of the one before; six copies of each, below the eight of a group that all tasks know."""
    texts = [" ".join([*(f"p{i - 1}_{k}" for k in range(10)), *(f"w{i}_{k}" for k in range(40)), *(f"p{i}_{k}" for k in range(10))]) for i in range(30)]
    rows = [(100 * j + i, t) for i, t in enumerate(texts) for j in range(6)]
    edges, grouped, found = candidates_of(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"), bitmap_bits=12, table_tokens=0)
    assert (edges, grouped) == (0, 0)
    assert found == {d: d % 100 for d, _ in rows}


def test_shingles_are_compared_by_their_words():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 4, n) for n in (1, 2, 2, 4, 5, 9, 30, 30)] + [np.array([0, 1, 2, 3])]
    got = jaccard_join.exact_sets(docs, 5)
    want = [{tuple(d[i : i + 5]) for i in range(max(1, len(d) - 4))} for d in docs]
    assert [len(s) for s in got] == [len(s) for s in want]
    assert all(len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]) for i in range(len(docs)) for j in range(len(docs)))


def removed(texts, width=20):
    """id: (words, removed, hash of what stays), window by window."""
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in texts if i is not None):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def check_removed(docs, texts):
    got = substring_dedup.dedup_substrings(docs).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == removed(texts)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["kept"].encode().split()) == r["n_words"] - r["n_removed"]
    words = {i: (t or "").split() for i, t in texts}
    for r in got:
        for f in r["factors"]:
            at = f["source_start"]
            assert (f["source"], at) < (r["doc_id"], f["start"])
            assert words[f["source"]][at : at + f["end"] - f["start"]] == words[r["doc_id"]][f["start"] : f["end"]]


def test_repeated_passages(documents, texts):
    check_removed(documents, list(texts.items()))


def test_repeated_passages_of_odd_texts(odd, nothing):
    check_removed(odd, ODD)
    assert substring_dedup.dedup_substrings(nothing).count() == 0
    null = substring_dedup.dedup_substrings(odd, carry=("score",)).filter("doc_id is null").first()
    assert (null["n_removed"], null["kept"], null["score"]) == (0, BASE, "clash")


def test_windows_inside_one_text(spark):
    rows = [(1, "x " * 50), (2, " ".join(map(str, range(25))) + " " + " ".join(map(str, range(5, 40))))]
    check_removed(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_factors_go_on_as_long_as_their_source(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", *a[5:50], *b[10:40], "y"])), (4, " ".join([*a[:19], "z", *a[20:60]]))]
    got = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [(1, 46, 1, 5), (46, 76, 2, 10)], 4: [(20, 60, 1, 20)]}


def test_factors_get_the_words_of_their_sources(spark):
    """A factor that a hash alone had found would be told from its source's words."""
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(20))), (2, " ".join(f"b{i}" for i in range(20)))], "doc_id long, text string")
    factors = spark.createDataFrame([(0, 2, 0, 20, 1, 0)], "part int, doc long, start long, length long, source long, source_start long")
    first = substring_dedup.with_source_words(factors, docs, 20, 10).first()
    assert bytes(first["first"]).decode() == docs.filter("doc_id = 1").first()["text"] and bytes(first["last"]) == bytes(first["first"])


def test_passages_of_rows_that_share_an_id(spark):
    own = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(1, own[0]), (1, own[1]), (2, own[1] + " tail"), (3, own[0]), (3, own[2])]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.filter("doc_id in (1, 2)").collect()) == [(1, 40, 0), (1, 40, 0), (2, 41, 40)]


def holding(docs, items):
    words = lambda t: LICENSE_WORD.findall(lower(t))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for j, t in items:
        w = words(t)
        k = min(5, len(w))
        q = grams(w, k) if w else set()
        for i, d in docs:
            if q and i is not None and (n := len(q & grams(words(d), k))) >= 0.75 * len(q):
                out[i, j] = (len(q), n)
    return out


def test_benchmark_items(spark, documents, texts, odd):
    items = [(i, " ".join((t or "").split()[k : k + 30])) for i, t in list(texts.items())[:20] for k in (10,)] + [(900, None), (901, "..."), (902, "the"), (903, texts[7][:200]), (903, texts[7][:200])]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    for docs, own in ((documents, list(texts.items())), (odd, ODD)):
        for options in ({}, {"broadcast_items": 0, "broadcast_pairs": 0}):
            got = decontamination.contaminated(docs, df, **options).collect()
            assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in got} == holding(own, items)


def test_items_whose_parts_stand_far_apart(spark):
    items = [(k, " ".join(f"item{k}w{i}" for i in range(200))) for k in range(8)]
    docs = []
    for k, text in items:
        w = text.split()
        docs.append((100 + k, " ".join(" ".join(w[25 * j : 25 * j + 25] + [f"other{k}x{j}x{i}" for i in range(700)]) for j in range(8))))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got) == [(100 + k, k, 196, 168) for k in range(8)]


def test_benchmark_without_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.contaminated(odd, items.filter("false")).count() == 0
    assert sorted(r["doc_id"] for r in decontamination.contaminated(odd, items).collect()) == [5, 6, 7, 8]


def test_token_files(spark, odd, nothing, documents, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = token_files.Encoder(path, 2)
    spaces = [(20, "a  b"), (21, " a b"), (22, "a\n b \n c"), (23, "<|endoftext|> q"), (24, "it's you're 12 3,4 ..!? \t x"), (25, "naïve café\u2003 über")]
    more = spark.createDataFrame(spaces, "doc_id long, text string")
    for docs, own in ((documents, list(texts.items())), (odd.select("doc_id", "text").unionByName(more), ODD + spaces)):
        got = token_files.token_files(docs, path, files=3, frame_bytes=4096).collect()
        at = 0
        assert len(got) == len(own)
        want = []
        for i, t in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = np.frombuffer(encode.whole(t or ""), "<u2").tolist() + [2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert token_files.token_files(nothing, path).count() == 0


def test_added_tokens_have_the_ids_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y plain words", "plain words", "a b<|endoftext|>"]
    own = token_files.Encoder(path, 2)
    library = Tokenizer.from_file(path)
    got = [np.frombuffer(x, own.kind).tolist() for x in own(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in got[0]


def test_random_white_space_has_the_ids_of_the_library():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    parts = np.array([" ", " ", " ", "  ", "\t", "\n", "\n", "\n\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "b", "word", "naïve", "e\u0301.", "don't", "x.", "y,", "!?", "12", "3,4", "…", "漢字", "<|endoftext|>"], dtype=object)
    weights = np.array([6.0] * 3 + [1] * 12 + [4] * 13 + [0.2])
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = token_files.Encoder(path, 2), Tokenizer.from_file(path)
    texts = ["a\tb  c", "a\xa0b  c", "tab\there two  spaces", "one\u3000two  three", "a\tb \t c"]
    texts += ["".join(parts[rng.choice(len(parts), rng.integers(1, 14), p=weights / weights.sum())]) for _ in range(100_000)]
    for at in range(0, len(texts), 512):
        chunk = texts[at : at + 512]
        want = [np.asarray(e.ids, own.kind).tobytes() for e in library.encode_batch(chunk, add_special_tokens=False)]
        assert own(chunk) == want
        if at < 5_000:  # an encoder that keeps next to nothing
            assert token_files.Encoder(path, 2, most=100)(chunk) == want


def test_random_words_of_letters_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    letters = np.array([*"abcdefghinorst" * 6, *"ABÀÖØÞßàöøÿĀĠġĳĸŉſƀμяª×÷ñ'’-.,1"], dtype=object)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = token_files.Encoder(path, 2), Tokenizer.from_file(path)
    words = ["".join(letters[rng.integers(0, len(letters), n)]) for n in rng.integers(1, 15, 60_000)]
    texts = [" ".join(words[i : i + 9]) + "\n" + " ".join(words[i + 9 : i + 20]) for i in range(0, len(words), 20)]
    want = [np.asarray(e.ids, own.kind).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own(texts) == want and own(texts) == want


def test_words_kept_are_bounded_in_number_and_length():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = token_files.Encoder(path, 2, most=50)
    texts = [f"x {'漢字' * 20}{i} w{chr(97 + i % 26)}{'o' * (i // 26 + 1)}." for i in range(200)]
    assert own(texts) == own(texts) == [own.whole(t) for t in texts]
    assert len(own.known) == 50 and max(map(len, own.known)) <= token_files.LONGEST


def test_workers_keep_their_encoder_from_task_to_task(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"plain words of text {i}") for i in range(40)], "doc_id long, text string")
    assert token_files.token_files(docs, path, files=4).count() == 40

    def kept(batches):
        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"n": [token_files.encoder.cache_info().currsize and len(token_files.encoder(path, 2).known)]})

    assert max(r["n"] for r in spark.range(0, 8, 1, 8).mapInPandas(kept, "n long").collect()) >= 4


def test_ids_beside_null_ids_stay_exact(spark):
    docs = spark.createDataFrame([(None, "a"), (2**53 + 1, "b c"), (5, None)], "doc_id long, text string")
    got = token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), files=1).collect()
    assert {(r["doc_id"], r["start"], r["n_tokens"]) for r in got} == {(None, 0, 2), (5, 2, 1), (2**53 + 1, 3, 3)}


@pytest.mark.parametrize("most", [1, 100, 1_000, 1 << 20])
def test_batches_by_bytes_keep_all_rows(most):
    import pyarrow as pa

    texts = ["", "x" * 300, "é" * 50, "", "y"] * 30 + ["z" * 5_000, ""]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = list(token_files.by_bytes(iter([rows.slice(0, 7), rows.slice(7, 0), rows.slice(7)]), "text", most))
    assert pa.concat_batches(got).equals(rows) and all(b.num_rows for b in got)
    assert all(sum(len(t.encode()) + 64 for t in b.column("text").to_pylist()[:-1]) < most for b in got)
    assert not list(token_files.by_bytes(iter([rows.slice(0, 0)]), "text", most))


def test_rows_of_one_id_are_dealt_to_several_files(spark):
    docs = spark.range(400).selectExpr("7 as doc_id", "concat('text ', id) as text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.token_files(docs, path, files=4).collect()
    assert len({r["file"] for r in got}) > 1 and sorted(r["start"] for r in got)[0] == 0
    ends = {r["start"] + r["n_tokens"] for r in got}
    assert len(got) == 400 and {r["start"] for r in got} - {0} == ends - {max(ends)}


def test_frames_decompress_alone_and_are_checked(tmp_path):
    import zstandard

    store, path = token_files.open_folder(f"file://{tmp_path}/x")
    out = store.open_output_stream(path, compression=None)
    w = token_files.FrameWriter(out, 2, 100, 1)
    docs = [np.arange(n, dtype="<u2") for n in (10, 80, 0, 3, 60)]
    places = [w.add(d.tobytes()) for d in docs]
    w.close()
    out.close()
    reader = token_files.FrameReader(store.open_input_file(path), 2)
    for d, (frame, place) in list(zip(docs, places))[::-1]:
        assert (reader.frame(frame)[place : place + len(d)] == d).all() if len(d) else True
    data = bytearray((tmp_path / "x").read_bytes())
    assert zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read() == b"".join(d.tobytes() for d in docs)
    data[-9 - 4] ^= 1  # the last entry's checksum
    (tmp_path / "x").write_bytes(data)
    broken = token_files.FrameReader(store.open_input_file(path), 2)
    with pytest.raises(ValueError, match="checksum"):
        broken.frame(len(broken.entries) - 1)


SIZES = (64, 128, 512)


@pytest.mark.parametrize("shard_rows", [50, 100_000])
def test_packing(spark, shard_rows):
    rng = np.random.default_rng(2)
    lengths = [(i, int(n)) for i, n in enumerate(rng.lognormal(4, 1.2, 600).astype(int) + 1)] + [(1000, None), (1001, 0), (1002, 5000), (None, 7), (5, 9)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long").withColumn("bin", F.lit("clash"))
    got = packing.pack_documents(df, sizes=SIZES, shard_rows=shard_rows).toPandas()
    assert got["length"].sum() == sum(n or 0 for _, n in lengths)
    bins = got.groupby("bin").agg(held=("length", "sum"), size=("bin_size", "first"))
    assert (bins["held"] <= bins["size"]).all()
    assert all(size == min(s for s in SIZES if s >= held) for held, size in bins.to_numpy())  # each bin is as small as its contents allow
    for _, b in got.sort_values("offset").groupby("bin"):
        assert (b["offset"].to_numpy() == np.concatenate([[0], b["length"].cumsum()[:-1]])).all()
    long = got[got["doc_id"] == 1002].sort_values("piece")
    assert long["length"].tolist() == [512] * 9 + [392] and long["start"].tolist() == list(range(0, 5000, 512))
    assert bins["held"].sum() / bins["size"].sum() > (0.97 if shard_rows > 1000 else 0.9)
    assert packing.pack_documents(df.filter("false"), sizes=SIZES).count() == 0


def test_rows_of_one_id_are_dealt_to_all_shards(spark):
    df = spark.range(4000).selectExpr("5L as doc_id", "100L as n_tokens")
    got = packing.pack_documents(df, shard_rows=500).selectExpr("split(bin, '-')[0] as shard").groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 1000


def test_packed_sequences_hold_the_documents(spark):
    rng = np.random.default_rng(4)
    docs = {i: [int(x) for x in rng.integers(1, 1000, n)] for i, n in enumerate(rng.integers(1, 400, 60))} | {100: list(range(1, 1301))}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, ids array<int>")
    packed = packing.pack_documents(df.select("doc_id", F.size("ids").alias("n_tokens")), sizes=SIZES, shard_rows=30)
    found = {}
    for r in packing.packed_sequences(df, packed).collect():
        assert len(r["ids"]) == r["bin_size"] and r["starts"] == sorted(r["starts"])
        for k, (at, doc) in enumerate(zip(r["starts"], r["documents"])):
            end = r["starts"][k + 1] if k + 1 < len(r["starts"]) else r["bin_size"]
            found.setdefault(doc, []).append([x for x in r["ids"][at:end] if x])
    pieces = {doc: sorted(own[i : i + 512] for i in range(0, len(own), 512)) for doc, own in docs.items()}
    assert {doc: sorted(own) for doc, own in found.items()} == pieces


def test_words_of_long_texts_are_all_there():
    assert len(LONG.split()) == 24_000
