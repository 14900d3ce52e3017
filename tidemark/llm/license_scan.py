"""License scans by diagonal voting, with DataFrame operations only.

All rolling word k-grams of the documents are hashed and joined to the positions at which the same k-grams stand in
license templates. A match of a template at word s of a document puts all its votes on the diagonal
``document position - template position = s``, so votes are counted by (document, template, diagonal), the diagonals of long templates
that lie close together are merged (words put in or left out shift the diagonal), and each k-gram is compared word by word with the
template before it votes, so that no hash collision counts. A merged span is then verified: a template position counts once, on however
many diagonals it voted, and the words that tell the template apart have to stand in the document where the span puts them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: (phrase, label): places of the whole phrase are counted.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: (text, label): longer wordings, found where most of their 3-grams stand on close diagonals.
LONG = [
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("this work is licensed under the gnu general public license version", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
#: The words of long wordings that other licenses' wordings have otherwise: without them, a span isn't that license.
TELLING = {
    "cc-by-nc": ["nc"],
    "cc-by-sa": ["sa"],
    "cc-by-nd": ["nd"],
    "gpl-notice": ["gnu", "general"],
    "apache-2.0": ["apache", "2"],
    "lgpl": ["gnu", "lesser"],
    "agpl": ["gnu", "affero"],
    "mpl-2.0": ["mozilla", "2"],
    "mit-text": ["permission", "hereby", "charge"],
    "bsd-text": ["redistribution", "source", "binary"],
    "unlicense": ["unencumbered"],
}
SHORT_K, LONG_K = 2, 3
#: Template positions in one mask.
BITS = 62


def template_grams(spark: SparkSession, base=BASE, long=LONG, telling=TELLING) -> DataFrame:
    """One row for each k-gram position of each template: as many rows as the templates, a parameter, have words."""
    rows = []
    for kind, k, templates in (("base", SHORT_K, base), ("long", LONG_K, long)):
        for text, label in templates:
            words = text.split()
            if len(words) < k:
                raise ValueError(f"template {text!r} is shorter than {k} words")
            n = len(words) - k + 1
            apart = [(words.index(x), x, 1 << j) for j, x in enumerate(telling.get(label, ()) if kind == "long" else ()) if x in words]
            rows += [(kind, text, label, i, n, apart, words[i], words[i + 1], words[i + 2] if k == 3 else None) for i in range(n)]
    grams = spark.createDataFrame(rows, "kind string, template string, label string, tpos int, grams int, apart array<struct<at:int,word:string,bit:bigint>>, g0 string, g1 string, g2 string")
    return grams.withColumn("h", F.when(F.col("kind") == "base", F.xxhash64("g0", "g1")).otherwise(F.xxhash64("g0", "g1", "g2")))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base=BASE, long=LONG, telling=TELLING, slack: int = 2, least: float = 0.6) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A base phrase counts at each place where its words stand consecutively. A long template adds its label where at least ``least`` of
    its 3-grams vote on diagonals at most ``slack`` apart and each of the label's ``telling`` words stands at most ``slack`` words from
    its place on one of them; score is the largest share of 3-grams of such spans of the document (1 with a base phrase).
    Null texts count as empty: no words, no labels, null first_word and last_word. Repeated rows each get their own row; an id may be
    null; further columns are ignored; an empty table gives no rows.
    """
    grams = template_grams(docs.sparkSession, base, long, telling)
    # Templates are a parameter of a few hundred words at most: their hashes pick the hits inside a text's array, before rows are made.
    known = {k: [r["h"] for r in grams.filter(F.col("kind") == kind).select("h").distinct().collect()] for kind, k in (("base", SHORT_K), ("long", LONG_K))}
    reach = max(len(t.split()) for t, _ in [*base, *long]) + slack
    d = docs.select(F.col(id_col).alias("_id"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(1)).alias("w"))
    d = d.withColumns({"_rid": F.monotonically_increasing_id(), "n_words": F.size("w").cast("long")})
    none = F.lit(None).cast("struct<pos:int,h:bigint,near:array<string>,at:int>")

    def hits_of(k: int):
        """pos, h, and the words around: all that a template that fits there may ask for, however long the text is."""
        gram = lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(F.col("w"), i + j) for j in range(k))).alias("h"))
        found = F.filter(F.transform(F.sequence(F.lit(0), F.size("w") - k), gram), lambda x: x["h"].isin(known[k]))
        around = lambda x: F.slice("w", F.greatest(x["pos"] - reach, F.lit(0)) + 1, F.lit(2 * reach + k))
        rows = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), around(x).alias("near"), F.least(x["pos"], F.lit(reach)).alias("at")))
        return F.when(F.col("n_words") >= k, rows).otherwise(F.array().cast("array<struct<pos:int,h:bigint,near:array<string>,at:int>>"))

    # The null at the end keeps documents without any hit in the one scan.
    d = d.select("_rid", "_id", "n_words", F.explode(F.concat(hits_of(SHORT_K), hits_of(LONG_K), F.array(none))).alias("x")).select("_rid", "_id", "n_words", "x.*")
    hits = d.join(F.broadcast(grams), "h", "left")
    same = (F.get("near", F.col("at")) == F.col("g0")) & (F.get("near", F.col("at") + 1) == F.col("g1")) & (F.col("g2").isNull() | (F.get("near", F.col("at") + 2) == F.col("g2")))
    hits = hits.filter(F.col("h").isNull() | same)
    # Telling words within slack of their places, counted in the words around.
    place, own = F.col("pos") - F.col("tpos"), F.col("at") - F.col("tpos")

    def met(t):
        first = F.greatest(own + t["at"] - slack, F.lit(0))
        around = F.slice("near", first + 1, F.greatest(own + t["at"] + slack - first + 1, F.lit(0)))
        return F.when(F.array_contains(around, t["word"]), t["bit"]).otherwise(F.lit(0).cast("long"))

    hits = hits.withColumn("met", F.aggregate("apart", F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(met(t))))
    masks = [f"mask{j}" for j in range(-(-max(len(t.split()) for t, _ in [*base, *long]) // BITS))]
    bit = F.expr(f"shiftleft(1L, tpos % {BITS})")
    template = ["kind", "template", "label", "grams"]
    votes = hits.groupBy("_rid", "_id", "n_words", *template, F.size("apart").alias("n_apart"), place.alias("diagonal")).agg(F.bit_or("met").alias("met"), *(F.bit_or(F.when(F.floor(F.col("tpos") / BITS) == j, bit)).alias(m) for j, m in enumerate(masks)))
    near = Window.partitionBy("_rid", "template").orderBy("diagonal")
    votes = votes.withColumn("new", F.when((F.col("kind") == "long") & (F.col("diagonal") - F.lag("diagonal").over(near) <= slack), 0).otherwise(1))
    votes = votes.withColumn("run", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy("_rid", "_id", "n_words", *template, "n_apart", "run").agg(F.bit_or("met").alias("met"), *(F.bit_or(m).alias(m) for m in masks), F.min("diagonal").alias("start"))
    spans = spans.withColumn("votes", reduce(lambda a, b: a + b, (F.coalesce(F.bit_count(m), F.lit(0)) for m in masks)))
    spans = spans.withColumn("share", F.when(F.bit_count("met") == F.col("n_apart"), F.col("votes") / F.col("grams")).otherwise(0.0))
    is_base = (F.col("kind") == "base") & (F.col("votes") == F.col("grams"))
    is_long = (F.col("kind") == "long") & (F.col("share") >= least)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("_rid", "_id", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start").cast("long"))).alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(is_base | is_long).alias("labels"),
        F.coalesce(F.max(F.when(is_base, F.lit(1.0)).when(F.col("kind") == "long", F.col("share"))), F.lit(0.0)).alias("score"),
    ).select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
