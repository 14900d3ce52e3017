import pytest
from pyspark.sql import functions as F

#: id, text: nulls, empty and very long texts, ties and near copies.
LONG = " ".join(f"word{i % 977} item{i % 613}" for i in range(12_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix jars of blue paint behind an old stone wall near the harbour today"
ODD = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "42 !!! ??"),
    (5, BASE),
    (6, BASE),
    (7, BASE.replace("seven", "eight")),
    (8, BASE.upper()),
    (9, "one two three"),
    (10, "one two three"),
    (11, LONG),
    (12, LONG + " tail"),
    (13, "Die Katze sitzt auf der alten Mauer und schaut in den Garten"),
    (None, BASE),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with columns whose names clash with those of results and of operators' insides."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ["score", "id", "n", "component", "component_id", "start", "kept", "lang_pred", "pos", "h", "w", "part", "n_words", "labels"]
    return df.withColumns({c: F.lit("clash") for c in names}).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
