import pytest
from pyspark.sql import types as T

from mailguard.llm.entry import tokenizer_path

LONG = "Overlong text with numbers 1234 and words. " * 6000    # about 260 KB

# Nulls, empty and very long texts, ties, repeated rows and columns with clashing names.
TEXTS = [(1, "one two three four five six"), (2, None), (3, ""), (3, ""), (None, "no id here at all"), (5, LONG),
         (6, LONG), (7, "One TWO three four five six"), (8, "Straße 😀 a@b.example.org café"), (8, "another text of id eight")]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "id", "score", "key", "row", "th", "kept", "spans", "carried", "fp")


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("doc_id", "n_chars") else T.StringType()) for c in COLUMNS])
    rest = ["x"] * (len(COLUMNS) - 5)
    rows = [(i, t, None if i == 1 else "en", "web", len(t or ""), *rest) for i, t in TEXTS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def tokenizer():
    return tokenizer_path()
