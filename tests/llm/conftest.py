import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))

EDGE_ROWS = [
    (1, "Alpha beta gamma delta epsilon\nThe shared line of text\nonly here one", "en"),
    (2, "  the SHARED line of text\t\nAlpha beta gamma zeta", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \t\n ", None),
    (6, "1234 5678 !!", "en"),
    (None, "A row without an id\nThe shared line of text", "en"),
    (7, LONG, "en"),
    (8, "word", "en"),
    (1, "Alpha beta gamma delta epsilon\nThe shared line of text\nonly here one", "en"),
    (9, "Alpha beta gamma delta epsilon\nThe shared line of text\nonly here one", "en"),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, blanks, a long text, repeated rows, and columns named like the operators' own."""
    docs = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string")
    for name in ("score", "kept", "body", "doc", "n", "shard", "lost_keys", "lost_doc", "kept_doc", "component", "rank"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.withColumn("n_chars", F.length("text")).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars int")
