import pytest

EDGE_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 70),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 70),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 70),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\r\n\x0b\x0c ", "fr", "b", 7),
    (6, "Élan naïve café\nÉlan naïve café\n\nx#*$", "fr", "c", 40),
    (7, "word " * 30000, "en", "a", 150000),
    (8, "x" * 50000, "de", "c", 50000),
    (None, "a row without an id but with words enough to be counted as a text of some length here", "en", "a", 90),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(EDGE_ROWS, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def odd_docs(edge_docs):
    """Extra columns whose names clash with what operators add."""
    from pyspark.sql import functions as F

    names = ["Score", "predicted", "size", "taken", "shard", "slot", "kept", "n_words", "fingerprint", "component_id", "sequence_id", "copies"]
    return edge_docs.select("*", *[F.lit("mine").alias(n) for n in names])


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
