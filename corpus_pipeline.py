"""A corpus pipeline: language, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gets all rows that the one before it kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.decontamination import contaminated
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.language_id import fit_language_model, identify_language
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import word_length
from tidemark.llm.substring_dedup import dedup_substrings

#: Below this share of belief in one language, a text is rejected.
LEAST_BELIEF = 0.4
#: Up to so many ids to remove are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in ids, a small table or a large one. Rows with a null id stay."""
    ids = cut(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, null ones among them, and those that no language of the corpus explains well."""
    found = identify_language(docs, fit_language_model(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_BELIEF)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of the smallest doc_id stays, and of rows that share a doc_id one."""
    found = jaccard_components(docs.select("doc_id", "text"))
    left = without(docs, found.filter(F.col("doc_id") != F.col("component_id")))
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter(F.col("count") > 1)
    if repeated.isEmpty():
        return left
    return without(left, repeated).unionByName(left.join(repeated.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words that earlier documents have too out of the texts; documents of which nothing is left go, untouched texts stay as they are."""
    own = {c: f"_own_{c}" for c in docs.columns if c != "doc_id"}
    found = dedup_substrings(docs.select("doc_id", *(F.col(c).alias(k) for c, k in own.items())), text_col=own["text"], carry=tuple(own.values()))
    found = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumnsRenamed({"kept": "_kept", "n_removed": "_removed"})
    found = found.select("doc_id", "_kept", "_removed", *(F.col(k).alias(c) for c, k in own.items()))
    cut_text = F.col("_removed") > 0
    new = {"text": F.when(cut_text, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut_text, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain three quarters or more of a benchmark item's shingles."""
    return without(docs, contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents, measured in words and an end mark, into training sequences."""
    return pack_documents(docs.select("doc_id", word_length(F.col("text")).alias("n_tokens")))


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_documents),
    ("best_fit_packing", pack),
]

#: Language identification and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
