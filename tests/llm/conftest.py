import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} the of" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [(1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
            (2, "the quick brown fox jumps over the lazy dog today", "en", "a"),
            (2, "the quick brown fox jumps over the lazy dog today", "en", "a"),
            (3, "", "de", "b"), (4, None, None, None), (None, "a text without an id", "en", "a"),
            (None, None, None, None), (5, LONG, "en", None), (6, "der schnelle braune Fuchs springt über den Hund", "de", "b"),
            (7, "  \t\n ", "de", "b"), (8, "***", None, "c"), (9, "Licensed under CC BY-NC 4.0. MIT license", "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["row", "key", "fp", "own", "size", "h", "score", "n_words", "_range", "_role", "k", "o", "n", "taken",
             "component_id", "block", "data", "rejected"]
    return df.withColumns({c: F.lit(c) for c in clash})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
