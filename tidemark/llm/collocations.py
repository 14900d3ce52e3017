"""Phrases whose words belong together, counted by a weighted graph of overlapping word sequences.

With phrases of up to N words, an edge is a sequence of N words in a piece of text, from the node of its first N-1 words to that of its
last N-1, with the number of its occurrences as weight. Only edges and the ends of pieces are counted in the texts. Every shorter count
is a flow: a sequence occurs as often as the edges, or next longer sequences, that begin with it, and as often as pieces end with it.

Paths without branches are compacted: where a node's occurrences are all entered by one edge and left by one, the two edges belong to
one path of a single weight, and the node, which always stands within a longer phrase of the same count, is no phrase of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, cut, partitions, small_batches

#: A word that makes more than this share of a sample of texts is common. Sequences of common words alone are dealt over several tasks;
#: at most 1/COMMON words are, and which ones are changes no result.
COMMON = 0.001
SAMPLE, SALTS = 2_000, 32
#: Bytes of text of which a task counts edges before it sends them on.
FLUSH = 16 << 20
BREAK, BLANK = 0, 1


class Ids(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Counter:
    """Edges and piece ends of texts, counted in memory until taken away."""

    #: A-Z lower-cased, ends of pieces as line feeds, tabs as blanks.
    TABLE = bytes.maketrans((UPPER + ".,;:!?\v\f\r\t").encode(), (LOWER + "\n" * 9 + " ").encode())

    def __init__(self, words: int):
        self.n, self.bytes = words, 0
        self.clear()

    def clear(self) -> None:
        self.ids = Ids({b"\n": BREAK, b"": BLANK})
        self.texts: dict[str, list] = {}
        self.bytes = 0

    def add(self, lang: str, text: str) -> None:
        import numpy as np

        data = text.encode("utf-8", "surrogatepass").translate(self.TABLE)
        words = data.replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        self.texts.setdefault(lang, []).append(found[found != BLANK])
        self.texts[lang].append(np.zeros(1, np.int64))
        self.bytes += len(data)

    def taken(self):
        """lang, sequences as rows of ids (a column each, 0 behind their ends), counts: for edges and for each length of piece end."""
        import numpy as np

        size = len(self.ids)
        for lang, held in self.texts.items():
            w = np.concatenate(held)
            word = w != BREAK
            codes, here = w, word  # of k words from each place on, and whether they are in one piece
            for k in range(1, self.n + 1):
                if k > 1:
                    if len(w) < k:
                        break
                    here = here[: len(w) - k + 1] & word[k - 1 :]
                    codes = self.joined(codes[: len(w) - k + 1], w[k - 1 :], size)
                pick = np.flatnonzero(here) if k == self.n else np.flatnonzero(here[: len(w) - k] & ~word[k:])
                if len(pick):
                    _, first, counts = np.unique(codes[pick], return_index=True, return_counts=True)
                    at = pick[first]
                    yield lang, [w[at + j] for j in range(k)], counts
        self.clear()

    @staticmethod
    def joined(codes, ids, size: int):
        """One number for each pair of a code and an id."""
        import numpy as np

        if len(codes) and int(codes.max()) >= (1 << 62) // size:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        return codes * size + ids


def count_sequences(docs: DataFrame, words: int, common: list[str]) -> DataFrame:
    """Partial counts c of grams: an edge's words but the last (its node), a tab, its last word (none where a piece ends with the node), a tab, lang.

    One short text for each, since these rows are most of what is shuffled. spread is -1, or the part of its edges for a node of common words.
    """
    small_batches(docs.sparkSession, 500)
    usual = set(x.encode("utf-8", "surrogatepass") for x in common)

    def each(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = Counter(words)

        def flush() -> Iterator:
            names = pa.array(list(counter.ids), pa.binary())
            special = np.fromiter((x in usual for x in counter.ids), bool, len(counter.ids))
            salts = np.fromiter((zlib.crc32(x) % SALTS for x in counter.ids), np.int64, len(counter.ids))
            for lang, sequence, counts in counter.taken():
                for at in range(0, len(counts), 1 << 17):
                    part = [r[at : at + (1 << 17)] for r in sequence]
                    head, edge = part[: words - 1], len(part) == words
                    node = pc.binary_join_element_wise(*(names.take(pa.array(r)) for r in head), pa.scalar(b" ", pa.binary()))
                    last = names.take(pa.array(part[-1])) if edge else pa.scalar(b"", pa.binary())
                    gram = pc.binary_join_element_wise(node, last, pa.scalar(lang.encode("utf-8", "surrogatepass"), pa.binary()), pa.scalar(b"\t", pa.binary()))
                    spread = np.where(np.all([special[r] for r in head], axis=0), salts[part[-1]] if edge else 0, -1)
                    yield pa.RecordBatch.from_arrays([gram.cast(pa.string()), pa.array(spread, pa.int32()), pa.array(counts[at : at + len(part[0])], pa.int64())], names=["gram", "spread", "c"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                counter.add(lang, text)
                if counter.bytes >= FLUSH:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(each, "gram string, spread int, c long")


def common_words(docs: DataFrame, bound: int = SAMPLE) -> list[str]:
    """Words that make more than COMMON of the words of about ``bound`` documents; they are fewer than 1/COMMON."""
    n = docs.count()
    some = docs.sample(min(1.0, bound / n), seed=1) if n else docs
    words = F.split(F.translate(F.col("text"), UPPER + ".,;:!?\n\x0b\x0c\r\t", LOWER + " " * 11), " ")
    counts = cut(some.select(F.explode(words).alias("word")).filter("word <> ''").groupBy("word").count())
    least = (counts.agg(F.sum("count")).first()[0] or 0) * COMMON
    return [r["word"] for r in counts.filter(F.col("count") > least).collect()]


def linked_paths(edges: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """lang, path (words), c: edges (lang, node, next, c) compacted along nodes (lang, node) that one edge enters and one leaves.

    An edge finds the head of its path by pointer doubling: each round doubles the reach of its link. A path is within one piece of
    text, whose ends are never such nodes, so that it has an end, and its length, and the logarithm of it the number of rounds, is bounded
    by the longest piece.
    """
    target = F.concat_ws(" ", F.slice(F.split("node", " "), 2, max(1, words - 2)), F.col("next")) if words > 2 else F.col("next")
    one = edges.select("lang", "node", "next", "c", target.alias("to"))
    inner = nodes.select(F.col("lang").alias("_l"), F.col("node").alias("_n"), F.lit(True).alias("_inner"))
    same = F.col("lang") == F.col("_l")
    # An edge is named by its node where that is inner (it has no other way out), and else stays the head of its own path.
    one = one.join(inner, same & (F.col("node") == F.col("_n")), "left").withColumnRenamed("_inner", "goes_on").drop("_l", "_n")
    one = one.join(inner, same & (F.col("to") == F.col("_n")), "left").withColumnRenamed("_inner", "goes_in").drop("_l", "_n")
    one = cut(one)
    alone = one.filter("goes_on is null and goes_in is null").select("lang", F.split(F.concat_ws(" ", "node", "next"), " ").alias("path"), "c")
    chained = one.filter("goes_on is not null or goes_in is not null")
    # up: the inner node whose entering edge is linked to; known once it is the path's head itself.
    up = chained.select("lang", "node", "next", "to", "c", "goes_in", F.col("goes_on").isNull().alias("done"), F.when(F.col("goes_on").isNull(), F.concat_ws(" ", "node", "next")).otherwise(F.col("node")).alias("up"), F.lit(0).cast("long").alias("far"))
    up = cut(up.withColumn("far", F.when(F.col("done"), 0).otherwise(1).cast("long")))
    while not up.filter("not done").isEmpty():
        # The edge that enters the inner node: there is just one.
        enters = up.filter("goes_in").select(F.col("lang").alias("_l"), F.col("to").alias("_at"), F.col("done").alias("_done"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        waits = up.filter("not done").join(enters, (F.col("lang") == F.col("_l")) & (F.col("up") == F.col("_at")))
        moved = waits.select("lang", "node", "next", "to", "c", "goes_in", F.col("_done").alias("done"), F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"))
        up = cut(up.filter("done").unionByName(moved))
    whole = up.groupBy("lang", "up", "c").agg(F.array_sort(F.collect_list(F.struct("far", "next"))).alias("run"))
    head = F.split("up", " ")
    path = F.concat(head, F.transform(F.slice("run", 2, F.greatest(F.size("run") - 1, F.lit(0))), lambda r: r["next"]))
    return alone.unionByName(whole.select("lang", path.alias("path"), "c"))


def counted(docs: DataFrame, words: int, least: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Edges (lang, node, next, c) with c >= least, and the flow of every node (lang, node, c), shorter piece ends among them."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    node = F.substring_index("gram", "\t", 1)
    dealt = count_sequences(rows, words, common_words(rows)).repartition(partitions(docs.sparkSession), node, "spread").withColumn("node", node)
    # Both aggregates use all columns of one exchange, and its partitioning, so that it is made once and is the only one.
    lang = F.expr("substr(gram, length(substring_index(gram, '\t', 2)) + 2)")
    edges = dealt.groupBy("node", "spread", "gram").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    edges = edges.select(lang.alias("lang"), "node", F.substring_index(F.substring_index("gram", "\t", 2), "\t", -1).alias("next"), "c", "spread")
    flows = dealt.groupBy("node", "spread", lang.alias("lang")).agg(F.sum("c").alias("c"))
    columns = ["lang", "node", "next", "c", "spread"]
    both = cut(edges.select(*columns).unionByName(flows.withColumn("next", F.lit(None).cast("string")).select(*columns)))
    flow = both.filter("next is null")
    split = cut(flow.filter("spread >= 0").groupBy("lang", "node").agg(F.sum("c").alias("c")))
    whole = flow.filter("spread < 0").select("lang", "node", "c")
    return both.filter("next <> ''").select("lang", "node", "next", "c"), whole.unionByName(split)


def shorter(nodes: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """Flows of sequences of k words: the next longer ones that begin so, and the pieces that end so."""
    first = F.substring_index("node", " ", k)
    both = nodes.select("lang", first.alias("node"), "c").unionByName(ends.select("lang", "node", "c"))
    return both.groupBy("lang", "node").agg(F.sum("c").alias("c"))


def n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def collocations(docs: DataFrame, *, words: int = 3, least: int = 10, share: int = 50, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text", paths: bool = False) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of phrases of 2 to ``words`` words that occur ``least`` times or more in a language.

    Texts (null: empty) are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and those at blanks and tabs. a, l and r
    count the phrase and the two parts of its cut with the lowest score, floor(1000000 * a * a / (l * r)), the first such cut on ties; n
    counts all words of the language (null: `und`). Phrases that stand in a longer one (of at most ``words`` words) with ``share``
    hundredths of their count are dropped. Ranks go by score, count, and phrase in order of UTF-8 bytes; ``top`` of each language stay
    (None: all). With ``paths`` the result is lang, path, c instead: the compacted paths of edges that occur ``least`` times or more.

    A very long text or piece is held whole in its task; repeated rows count as often as they are there; empty tables and languages
    without such phrases give no rows; other columns are left aside. Counts are sums of 64 bits, products of 38 decimal digits.
    """
    if words < 2 or not 0 < share <= 100:
        raise ValueError("phrases have two words or more, and a share is between 1 and 100")
    edges, flows = counted(docs, words, least, lang_col, text_col)
    length = n_words(F.col("node"))
    # Flows by length, from the nodes down to single words, each of them whole before the next shorter one is made from it.
    by_length = {words - 1: flows.filter(length == words - 1)}
    for k in range(words - 2, 0, -1):
        by_length[k] = cut(shorter(by_length[k + 1], flows.filter(length == k), k))
    often = {k: by_length[k].filter(F.col("c") >= least) for k in by_length}
    last = F.concat_ws(" ", F.slice(F.split("node", " "), 2, max(1, words - 2)), F.col("next")) if words > 2 else F.col("next")
    # What enters and leaves a node.
    out = edges.select("lang", "node", F.col("c").alias("leaves"), F.lit(0).cast("long").alias("enters"))
    into = edges.select("lang", last.alias("node"), F.lit(0).cast("long").alias("leaves"), F.col("c").alias("enters"))
    sides = out.unionByName(into).groupBy("lang", "node").agg(F.max("leaves").alias("leaves"), F.max("enters").alias("enters"))
    nodes = cut(often[words - 1].join(sides, ["lang", "node"], "left").select("lang", "node", "c", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("enters", F.lit(0)).alias("enters")))
    inner = nodes.filter("leaves = c and enters = c").select("lang", "node")
    compact = linked_paths(edges, inner, words)
    if paths:
        return compact
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - (words - 1)), lambda i: F.array_join(F.slice("path", i, F.lit(words)), " "))
    found = {words: compact.select("lang", F.explode(steps).alias("phrase"), "c", F.lit(0).cast("long").alias("longer"))}
    if words > 2:
        rest = nodes.filter("leaves < c or enters < c")
        found[words - 1] = rest.select("lang", F.col("node").alias("phrase"), "c", F.greatest("leaves", "enters").alias("longer"))
    for k in range(words - 2, 1, -1):
        parts = often[k + 1].select("lang", F.explode(F.array(F.substring_index("node", " ", k), F.substring_index("node", " ", -k))).alias("_p"), F.col("c").alias("_c"))
        best = parts.groupBy(F.col("lang").alias("_l"), "_p").agg(F.max("_c").alias("longer"))
        joined = often[k].join(best, (F.col("lang") == F.col("_l")) & (F.col("node") == F.col("_p")), "left")
        found[k] = joined.select("lang", F.col("node").alias("phrase"), "c", F.coalesce("longer", F.lit(0).cast("long")).alias("longer"))
    all_words = by_length[1].groupBy("lang").agg(F.sum("c").alias("n"))
    scored = None
    for m, phrases in found.items():
        left = phrases.filter(100 * F.col("longer").cast("decimal(38,0)") < share * F.col("c").cast("decimal(38,0)")).select("lang", "phrase", F.col("c").alias("a"))
        for k in range(1, m):
            for name, part, size in ((f"l{k}", F.substring_index("phrase", " ", k), k), (f"r{k}", F.substring_index("phrase", " ", k - m), m - k)):
                own = often[size].select(F.col("lang").alias("_l"), F.col("node").alias("_n"), F.col("c").alias(name))
                left = left.join(own, (F.col("lang") == F.col("_l")) & (part == F.col("_n"))).drop("_l", "_n")
        whole = "cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))"
        cuts = F.array(*(F.struct(F.expr(f"({whole}) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)))
        left = left.select("lang", "phrase", "a", F.array_min(cuts).alias("cut"))
        scored = left if scored is None else scored.unionByName(left)
    ranked = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is not None:  # the best of each of several parts of a language, then the best of those
        part = F.pmod(F.xxhash64("phrase"), F.lit(256))
        ranked = ranked.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
