from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_pii_decontaminate import slow_base, words
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [words(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9))}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        after_df = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r for r in after_df.collect()}
        assert set(after) <= set(before)
        if name == "best_fit_packing":
            assert set(after) == set(before)
            break
        assert after_df.columns == docs.columns
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "simhash_near_dedup":
            ids = sorted(before)
            assert set(after) == set(slow_components([slow_fingerprint(before[i]["text"]) for i in ids], ids))
        if name == "benchmark_decontamination":
            bad = {i for i, r in before.items() for w in [words(r["text"])] if any(tuple(w[j : j + 10]) in grams for j in range(len(w)))}
            assert set(after) == set(before) - bad
        if name == "pii_redaction":
            assert set(after) == set(before)
            assert not any(slow_base(r["text"]) for r in after.values())
            assert all(after[i]["text"] == r["text"] for i, r in before.items() if not any(c.isdigit() or c == "@" for c in r["text"]))
        docs = after_df


def test_run_is_registered(spark, small):
    assert __spark_entry__.queries()["pipeline"](spark, small).count() > 0
    assert sum(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries()) == 10


@pytest.mark.parametrize("kind", ["odd", "empty", "unlabelled"])
def test_run_on_odd_tables(spark, small, odd, none, tmp_path, kind):
    """Nulls, repeated rows and ids, very long texts, columns with clashing names, no rows, no labels: every stage ends, and its rows are of its predecessor's."""
    docs = {"odd": odd, "empty": none, "unlabelled": odd.withColumn("lang", F.lit(None).cast("string"))}[kind]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(rows) > 0) == (kind != "empty")
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    assert all(len(r["ids"]) == r["length"] <= 2048 for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        assert [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))]
