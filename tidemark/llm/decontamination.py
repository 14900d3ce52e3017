"""Benchmark decontamination by MinHash containment search, with DataFrame operations only.

An item's signature is the least of its shingles under each of ``signature`` hash orders. The share of it that stands anywhere in a
document estimates the item's containment there (the containment form of MinHash: the least shingle of the small set is looked up in the
large one, so the large one's size doesn't matter, nor how far apart an item's parts stand). Pairs above ``estimate`` are verified by
exact containment of shingles, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased: punctuation and line breaks don't matter."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def windows(w: Column, width: int, make) -> Column:
    """make(list of width words) at each position; an empty array where w is shorter."""
    at = lambda i: make([F.get(w, i + j) for j in range(width)])
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), at))


def text_of(ws: list[Column]) -> Column:
    return F.concat_ws(" ", *ws)


def by_width(w: Column, width: Column, most: int, make) -> Column:
    """windows() of a width that differs by row, 1 to most."""
    out = windows(w, 1, make)
    for k in range(2, most + 1):
        out = F.when(width == k, windows(w, k, make)).otherwise(out)
    return out


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    containment: float = 0.75,
    signature: int = 16,
    estimate: float = 0.25,
    broadcast_items: int = 50_000,
    broadcast_pairs: int = 500_000,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """One row for each document and item of which it contains at least ``containment``: id, item id, n_item, n_shared, containment.

    Items of fewer than ``width`` words are one shingle of all their words; those without words, null ones among them, are in no
    document. Null texts contain nothing. Rows with a null id are left out; rows that share an id count as one document or item.
    Items with equal texts are searched once and each reported. Signatures of up to broadcast_items items are broadcast, and all items'
    shingles up to broadcast_bytes of text; larger ones are joined by shuffles. Texts of any length are searched whole. Further columns are ignored; without documents or items there are no rows.
    """
    own = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).filter(F.col("item").isNotNull() & (F.size("w") > 0))
    own = own.withColumn("width", F.least(F.lit(width), F.size("w")))
    own = own.withColumn("shingles", F.array_distinct(by_width(F.col("w"), F.col("width"), width, text_of)))
    own = own.withColumn("hashes", F.array_distinct(by_width(F.col("w"), F.col("width"), width, lambda ws: F.xxhash64(*ws))))
    own = cut(own.select("item", "width", "shingles", "hashes", F.size("shingles").alias("n_item")))
    n_items, bytes_of = own.agg(F.count("*"), F.sum(F.octet_length(F.array_join("shingles", " ")))).first()
    widths = sorted(r["width"] for r in own.select("width").distinct().collect())  # 1 to width at most
    few = n_items <= broadcast_items
    # Searched texts: items with the same shingles stand for one another.
    sets = own.groupBy(F.xxhash64(F.array_sort("hashes")).alias("set")).agg(F.min_by("hashes", "item").alias("hashes"), F.first("width").alias("width"))
    seeded = lambda j: F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, j).alias("order"), h.alias("h"))))["h"]
    keys = sets.select("set", "width", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(signature)), seeded))).alias("h"))
    n_keys = keys.groupBy("set").agg(F.count("*").alias("n_keys"))

    d = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w")).filter(F.col("doc").isNotNull())
    hashed = F.concat(*(F.coalesce(windows(F.col("w"), k, lambda ws, k=k: F.struct(F.lit(k).alias("width"), F.xxhash64(*ws).alias("h"))), F.array().cast("array<struct<width:int,h:bigint>>")) for k in widths)) if widths else F.array().cast("array<struct<width:int,h:bigint>>")
    if widths == [width]:
        hashed = F.coalesce(windows(F.col("w"), width, lambda ws: F.xxhash64(*ws)), F.array().cast("array<bigint>"))
        d = d.select("doc", F.explode(hashed).alias("h")).withColumn("width", F.lit(width))
    else:
        d = d.select("doc", F.explode(hashed).alias("s")).select("doc", F.col("s.width").alias("width"), F.col("s.h").alias("h"))
    hits = d.join(F.broadcast(keys) if few else keys, ["h", "width"])
    found = hits.select("doc", "set", "h").distinct().groupBy("doc", "set").agg(F.count("*").alias("n"))
    pairs = found.join(F.broadcast(n_keys) if few else n_keys, "set").filter(F.col("n") >= F.col("n_keys") * estimate)
    per_doc = cut(pairs.groupBy("doc").agg(F.collect_set("set").alias("sets")))
    some = per_doc.count() <= broadcast_pairs

    texts = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w")).join(F.broadcast(per_doc) if some else per_doc, "doc")
    of_width = [F.coalesce(windows(F.col("w"), k, text_of), F.array().cast("array<string>")) for k in widths]
    texts = texts.select("doc", "sets", (F.array_distinct(F.concat(*of_width)) if widths else F.array().cast("array<string>")).alias("has"))
    texts = texts.select("doc", "has", F.explode("sets").alias("set"))
    named = own.withColumn("set", F.xxhash64(F.array_sort("hashes"))).select("set", "item", "n_item", "shingles")
    shared = texts.join(F.broadcast(named) if (bytes_of or 0) <= broadcast_bytes else named, "set").select("doc", "item", "n_item", F.explode(F.array_intersect("shingles", "has")).alias("shingle"))
    out = shared.groupBy("doc", "item", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= containment)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("n_item").cast("long").alias("n_item"), "n_shared", "containment")


CONTAMINATED_SQL = r"""
with item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k+4], ' '))) as s from item where len(w) > 0),
n as (select item_id, count(*) as n_item from i group by item_id),
d as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) as s from doc where len(w) >= 5),
c as (select doc_id, item_id, count(*) as n_shared from d join i using (s) group by all)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from c join n using (item_id) where n_shared / n_item >= 0.75
"""
