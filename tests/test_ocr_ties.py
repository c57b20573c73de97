"""Confidences of paragraphs whose mean is half way between two ten-thousandths."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillframe.operators import ocr


def test_means_are_rounded_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sums = (2199, 6799, 8999)
    words = [(page, i, 0, 0, 0, "w", 10 * i, 0, 8, 20, s // 200 + (i < s % 200)) for page, s in enumerate(sums) for i in range(200)]
    df = spark.createDataFrame(words, "page int, ord int, block int, par int, line int, text string, left int, top int, width int, height int, conf int")
    got = [r["confidence"] for r in ocr.word_elements(df, ["page"], F.lit(2000.0), F.lit(2000.0)).orderBy("page").collect()]
    assert got == [duckdb.execute(f"select round({s} / 200 / 100, 4)").fetchone()[0] for s in sums]
