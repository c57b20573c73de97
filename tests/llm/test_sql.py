"""Queries of this folder against their SQL in another engine, on the smallest tables and on odd rows."""

from __future__ import annotations

import pytest

from quillframe.llm import registry

pytest.importorskip("duckdb")
TABLES = ("documents", "benchmark", "pages", "conversations", "embeddings")


def same(spark, folder, name, tables=TABLES):
    import duckdb

    engine = duckdb.connect()
    for table in tables:
        path = f"{folder}/{table}.parquet"
        engine.execute(f"create view {table} as select * from '{path}{'' if path.startswith('/root') else '/*.parquet'}'")
    df = registry.queries()[name](spark, str(folder))
    found = engine.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in found.description]
    names = sorted(theirs)
    assert sorted(df.columns) == names
    want = sorted(repr(tuple(r[theirs.index(c)] for c in names)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    same(spark, small, name)


def test_odd_conversations_equal_sql(spark, tmp_path):
    texts = ["</turn>", "<turn>x\n", "\\", "<\\turn>", None, "", "é😀\\n", "a<turn>b</turn>c\\", "<turn></turn><turn>"]
    rows = [(1, i, ["user", "assistant", "a\nb\\n<turn>", None][i % 4], t) for i, t in enumerate(texts)]
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (-7, 5, "assistant", "more"), (4, 0, "assistant", "word " * 20000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(spark, tmp_path, "op5_chat_formatting", ["conversations"])


def test_odd_pages_equal_sql(spark, tmp_path):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate([None, "", "a", "a", "é\r\n\r\nx", "x" * 1_000_000, "b"])]
    rows += [(2, "http://again", "a"), (None, "u", "b"), (None, "u", "c"), (None, "u", "c"), (9, None, "é\r\n\r\nx")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same(spark, tmp_path, "op8_warc", ["pages"])
