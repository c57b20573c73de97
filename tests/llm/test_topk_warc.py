from __future__ import annotations

import base64
import hashlib
import random

import pytest

from quillframe.llm import registry, topk, warc


def code(v):
    return sum(1 << i for i, x in enumerate(v[:64]) if x is not None and x > 0)


def slow_top_k(rows, k, every):
    rows = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    out = []
    for q, a in rows:
        if q % every == 0:
            near = sorted(((a ^ b).bit_count(), i) for i, b in rows)[:k]
            out += [repr((q, i, d, n + 1)) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_embeddings(spark, small):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(repr(tuple(r)) for r in registry.op7_hamming_top_k(spark, small).collect()) == slow_top_k(rows, 10, 20)


def test_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(5, rows[0][1]), (5, rows[0][1]), (20, rows[0][1]), (None, rows[0][1]), (40, None), (60, []), (80, [None, 1.0]), (99, [0.0] * 70)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert sorted(repr(tuple(r)) for r in topk.hamming_top_k(df, 4, 5).collect()) == slow_top_k(rows, 4, 5)
    few = df.where("vec_id < 4")
    assert sorted(repr(tuple(r)) for r in topk.hamming_top_k(few, 10, 2).collect()) == slow_top_k(rows[:4], 10, 2)
    assert topk.hamming_top_k(df.limit(0)).count() == 0


def test_near_neighbours_end_the_search_in_its_first_rounds(spark, monkeypatch):
    """Clusters of codes within a few bits: every query ends by round 2, though blocks are tiny and one segment value is everywhere."""
    rng = random.Random(9)
    centres = [rng.getrandbits(48) << 16 | 0xBEEF for _ in range(12)]
    codes = [c ^ sum(1 << b for b in rng.sample(range(16, 64), rng.randrange(3))) for c in centres for _ in range(25)]
    rows = [(i, [1.0 if c >> b & 1 else -1.0 for b in range(64)]) for i, c in enumerate(codes)]
    seen = []
    steps = topk.steps
    monkeypatch.setattr(topk, "steps", lambda *x: (seen.append(s[-1]) or s for s in steps(*x)))
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "PAIRS", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(repr(tuple(r)) for r in topk.hamming_top_k(df, 5, 3).collect()) == slow_top_k(rows, 5, 3)
    assert seen and seen[-1][0] <= 2


def slow_archive(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in data:
        ids = [j for j, q in data if q == p and j is not None]
        first = min(ids, default=None)
        revisit = len([1 for _, q in data if q == p]) > 1 and first is not None and i != first
        out.append(repr((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)))
    return sorted(out)


def test_pages(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(repr(tuple(r)) for r in registry.op8_warc(spark, small).collect()) == slow_archive(rows)


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_odd_pages_and_seeking(spark, tmp_path, monkeypatch, most):
    htmls = [None, "", "a", "a", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "x" * 3_000_000, "b"]
    rows = [(i, None if i == 1 else f"http://h/{i}\r\nX: y é", h) for i, h in enumerate(htmls)]
    rows += [(2, "http://again", "a"), (None, "u", "b"), (None, "u", "c"), (None, "u", "c")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string")
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)
    folder = f"file://{tmp_path}/out"
    index = warc.write_bundles(df, folder)
    got = warc.read_bundles(spark, index, folder).collect()
    assert all(r["digest_ok"] for r in got)
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == slow_archive(rows)
    assert index.select("record_id").distinct().count() == len(rows)
    assert warc.read_bundles(spark, index, folder).rdd.getNumPartitions() == index.select("bundle").distinct().count()
    for row in index.collect():
        headers, _, payload = warc.read_record(folder, row)
        assert headers["WARC-Record-ID"] == row["record_id"]
        if headers["WARC-Type"] == "revisit":
            first = min((i, u or "") for i, u, h in rows if i is not None and i == int(headers["X-Refers-To-Page-Id"]))
            assert headers["WARC-Refers-To-Target-URI"] == warc.target(first[1])
        if headers["WARC-Type"] == "response":
            assert warc.digest(payload) == headers["WARC-Payload-Digest"].removeprefix("sha1:")
    assert warc.archive_pages(df.limit(0)).count() == 0
