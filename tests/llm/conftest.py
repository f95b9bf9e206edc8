import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977}" for i in range(20000))
BASE = "The quick brown fox jumps over the lazy dog near the river bank while seven ducks watch it closely and count every leap it makes today."
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, BASE, "en", "a", len(BASE)), (5, BASE, "en", "b", len(BASE)), (5, BASE, "en", "b", len(BASE)),
    (6, LONG, "en", "b", len(LONG)), (7, "x", None, None, 1), (None, "no id here", "en", "a", 10), (8, "é🙂 ünï\u0000code ﬁ", "fr", "c", 12), (9, "12345 67890 !!!", "de", "c", 15),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank, very long and repeated texts, repeated rows, a null id, extra columns with likely names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCS)
    for name in ("media", "samples", "hash", "fp", "node", "row", "key", "ids", "score", "start", "weight", "copies", "host", "removed_", "count", "value", "base", "found", "a", "b", "text__x"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
