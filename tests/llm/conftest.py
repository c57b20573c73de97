from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, rank int, words string"


def rows_of(texts, lang="en"):
    """Rows of SCHEMA, which has columns with names that operators use too."""
    return [(i, t, lang, "s", None if t is None else len(t), "mine", 7.0, 3, "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns."""
    texts = [None, "", " \t\n", "one", "One", "a b c d e f g h i j k", "a b c d e f g h i j k", "word " * 30000, "\u3000é Straße İ \U0001f600", "x" * 50000]
    rows = rows_of(texts)
    rows += [rows[5], (None, "a b c d e f g h i j k", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, "another text under the same id", "en", "s", 1, "", 0.0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
