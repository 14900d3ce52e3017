"""URL filters: rules by host and path, and for the rest a character language-model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, are smoothed by interpolation (Witten-Bell): a context of the last
characters is extended only where it has enough symbols, and each order backs off to the shorter one. A URL is rejected where the
difference of the two log-likelihoods, divided by its length, lies above a threshold calibrated on URLs that the models haven't seen.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, each_text, partitions, schema_and

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/ ? #`` with A-Z lower-cased, then the path up to ``? #``; else both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does. Of rules of one length the first wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


@dataclass
class UrlModel:
    """counts: gram (a context and the symbol behind it), n0 and n1 (how often accepted and rejected URLs hold it)."""

    counts: DataFrame
    order: int
    alphabet: int
    least_count: int


def full_grams(url: str, order: int) -> list[str]:
    """Each symbol of a URL with the longest context before it."""
    s = START + url + END
    return [s[max(0, i - order) : i + 1] for i in range(1, len(s))]


def suffixes(grams: DataFrame) -> DataFrame:
    """grams with each of its suffixes: the same symbols with all shorter contexts."""
    return grams.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.right("gram", k))))


def fit_url_model(urls: DataFrame, *, order: int = 5, least_count: int = 4) -> UrlModel | None:
    """urls: url string, kind int (0 accepted, 1 rejected). None where a class is missing: nothing to tell apart.

    All URLs count, and all that they hold is kept: the counts are a table of Spark's, which grows with urls and never passes through
    the driver. A context is used by a class that holds least_count symbols behind it, however large the class is.
    """

    def grams(batches):
        for b in batches:
            n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for url, kind in zip(b["url"], b["kind"]):
                for gram in full_grams(url, order):
                    n[gram][kind] += 1
            yield pd.DataFrame({"gram": list(n), "n0": [x for x, _ in n.values()], "n1": [x for _, x in n.values()]})

    known = urls.filter(F.col("url").isNotNull() & F.col("kind").isin(0, 1)).select("url", "kind")
    sums = F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    full = known.mapInPandas(grams, "gram string, n0 long, n1 long").groupBy("gram").agg(*sums)
    counts = cut(suffixes(full).groupBy("gram").agg(*sums))
    seen = counts.filter(F.length("gram") == 1).agg(F.count("*").alias("symbols"), *sums).first()  # one row
    if not seen["n0"] or not seen["n1"]:
        return None
    return UrlModel(counts, order, max(2, seen["symbols"] + 1), least_count)


def gram_differences(grams: DataFrame, model: UrlModel) -> DataFrame:
    """gram, delta: rejected minus accepted log probability of the last symbol, for distinct grams and all their suffixes.

    From the empty context on, each length is joined to the one below it. No key has more rows than there are symbols.
    """
    needed = cut(suffixes(grams.select("gram")).distinct().join(model.counts, "gram", "left").na.fill(0, ["n0", "n1"]))
    context = F.substring("gram", F.lit(1), F.length("gram") - 1)
    distinct = [F.count(F.when(F.col(f"n{k}") > 0, 1)).alias(f"d{k}") for k in (0, 1)]
    contexts = model.counts.groupBy(context.alias("context"), F.length("gram").alias("length")).agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), *distinct)
    contexts = cut(contexts.filter(F.greatest("all0", "all1") >= model.least_count))
    levels: list[DataFrame] = []
    for length in range(1, model.order + 2):
        own = needed.filter(F.length("gram") == length).withColumn("context", context)
        own = own.join(contexts.filter(F.col("length") == length).drop("length"), "context", "left")
        if levels:
            below = levels[-1].select(F.col("gram").alias("rest"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            own = own.withColumn("rest", F.right("gram", F.lit(length - 1))).join(below, "rest")
        else:
            own = own.withColumns({f"q{k}": F.lit(1.0 / model.alphabet) for k in (0, 1)})
        mixed = {k: (F.col(f"n{k}") + F.col(f"d{k}") * F.col(f"q{k}")) / (F.col(f"all{k}") + F.col(f"d{k}")) for k in (0, 1)}
        enough = {k: F.coalesce(F.col(f"all{k}"), F.lit(0)) >= model.least_count for k in (0, 1)}
        levels.append(cut(own.select("gram", *(F.when(enough[k], mixed[k]).otherwise(F.col(f"q{k}")).alias(f"p{k}") for k in (0, 1)))))
    return reduce(DataFrame.unionByName, levels).select("gram", (F.log("p1") - F.log("p0")).alias("delta"))


def difference(rows: DataFrame, model: UrlModel | None, url_col: str = "url", part_rows: int = 20_000) -> DataFrame:
    """rows with _difference: rejected minus accepted log-likelihood for each character; 0 for null, and for all without a model.

    Rows are dealt to parts of about part_rows; a part asks for each of its distinct grams once, so that frequent ones are no load.
    """
    if model is None:
        return rows.withColumn("_difference", F.lit(0.0))
    order, schema = model.order, schema_and(rows, _difference="double")
    parts = max(partitions(rows.sparkSession), -(-rows.count() // part_rows))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))

    def ask(b):
        import pyarrow as pa

        found: set[str] = set()
        for url in each_text(b, url_col):
            found.update(full_grams(url, order))
        return pa.table({"_part": pa.array([b.column("_part")[0].as_py()] * len(found), pa.int32()), "gram": pa.array(list(found), pa.string())})

    def score(b, grams):
        import pyarrow as pa

        delta = dict(zip(grams.column("gram").to_pylist(), grams.column("delta").to_pylist()))
        found = [0.0 if u is None else sum(delta[g] for g in full_grams(u, order)) / (len(u) + 1) for u in each_text(b, url_col)]
        return b.drop_columns(["_part"]).append_column("_difference", pa.array(found, pa.float64()))

    asked = cut(dealt.filter(F.col(url_col).isNotNull()).select("_part", url_col).groupBy("_part").applyInArrow(ask, "_part int, gram string"))
    answers = asked.join(gram_differences(asked.select("gram").distinct(), model), "gram").select("_part", "gram", "delta")
    return dealt.groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(score, schema)


def fewest_errors(scored: DataFrame) -> float:
    """The threshold of the fewest errors on scored's kind and _difference, from a histogram of the differences."""
    binned = scored.withColumn("bin", F.greatest(F.lit(-500), F.least(F.lit(500), F.floor(F.col("_difference") * 100).cast("int"))))
    bins = {(r["bin"], r["kind"]): r["n"] for r in binned.groupBy("bin", "kind").agg(F.count("*").alias("n")).collect()}
    edges = range(-500, 502)
    errors = [sum(n for (b, k), n in bins.items() if (b >= e) != (k == 1)) for e in edges]
    best = min(errors)
    return min((e for e, x in zip(edges, errors) if x == best), key=abs) / 100


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, difference.

    The rules' own verdicts are the labels from which the models learn. A null or schemeless URL has an empty host and path, so that
    no rule fits; a null URL has difference 0. Without a class to learn from, the other one's verdict holds (allow without both).
    Repeated rows each get their row; further columns are ignored.
    """
    host, path = host_and_path(F.col("_url"))
    d = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns({"_host": host, "_path": path})
    rule, verdict = fitting_rule(F.col("_host"), F.col("_path"), rules)
    kind = F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0)
    d = d.withColumns({"_rule": rule, "_verdict": verdict})
    held = F.pmod(F.xxhash64("_url"), F.lit(5)) == 0
    model = fit_url_model(d.filter(~held).select(F.col("_url").alias("url"), kind.alias("kind")))
    if model is None:
        seen = {r["kind"] for r in d.filter(~held).select(kind.alias("kind")).distinct().collect()}  # three at most
        d, least = difference(d, None, "_url"), float("-inf") if 1 in seen else float("inf")
    else:
        # The threshold comes from URLs that the models haven't seen.
        d = cut(difference(d, model, "_url"))
        least = fewest_errors(d.filter(held & F.col("_url").isNotNull() & kind.isNotNull()).select(kind.alias("kind"), "_difference"))
    by_model = F.when(F.col("_difference") >= least, "block").otherwise("allow")
    return d.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", by_model).alias("verdict"), F.col("_difference").alias("difference"))
