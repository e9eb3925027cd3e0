from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("Shard", T.StringType()), T.StructField("size", T.StringType())])


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 34, "x", "y"),
        (1, "one two three four five six seven", "en", "a", 34, "x", "y"),
        (2, "one two three four five six seven", "en", "b", 34, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, None, None),
        (5, " \t\n ", "fr", "b", 4, None, None),
        (6, "Ünï côdé ___ 12 ñandú", "es", None, 21, None, None),
        (7, "word " * 30_000, "en", "a", 150_000, None, None),
        (8, "ONE  two\tthree\nfour FIVE six seven", "en", "a", 35, None, None),
        (None, "a text without an id of its own here", "de", "b", 36, None, None),
        (9, "short", "de", "c", 5, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
