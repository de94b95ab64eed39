"""Tables for the operators: a small given table, and one of edge cases."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
# columns whose names clash with what operators call their own
CLASHING = ("kept", "h", "row", "id", "words", "label", "class_id", "size", "spans", "text_", "t")

LONG_RUN = "a" * 60_000
LONG_TEXT = " ".join(f"w{i % 977} x{i % 31}" for i in range(12_000))
EDGE = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "  \n\t ", None, "s2"),
    (4, "one two", "en", None), (5, "one two", "en", None), (5, "one two", "en", None),
    (6, LONG_RUN, "en", "s1"), (7, LONG_TEXT, "en", "s1"), (8, LONG_TEXT, "en", "s2"),
    (None, "a row without an id, mail me at some.one@example.com", "en", "s2"), (None, None, None, None),
    (9, "déjà vu ▁ \x00 😀  + 1.2.3.4 4111 1111 1111 1111", "fr", "s3"),
    (10, "7" * 50_000, "en", "s3"), (11, "+" * 300 + "@" * 300 + "1." * 500, "en", "s3"),
]


def edge_docs(spark, rows=EDGE):
    d = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows],
                              "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def edge(spark):
    return edge_docs(spark)


@pytest.fixture(scope="session")
def nothing(spark):
    return edge_docs(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
