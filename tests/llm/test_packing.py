from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillframe.llm import packing
from quillframe.llm.registry import TOKENIZER


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(TOKENIZER)


def check(df, rows, whole, size=2048):
    want = []
    for doc_id, text in df.select("doc_id", "text").collect():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), size)):
            part = ids[a : a + size]
            want.append(repr((doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))))
    assert sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_documents_in_few_sequences(docs, whole):
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    bins = check(docs, rows, whole)
    assert bins <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


def test_many_groups(docs, whole):
    rows = packing.assign(packing.pieces(docs, TOKENIZER, 512), 512, per_group=20).collect()
    bins = check(docs, rows, whole, 512)
    assert bins <= 1.02 * sum(r["length"] for r in rows) / 512 + 2


def test_odd_rows(odd, none, whole):
    check(odd, packing.pack_documents(odd, TOKENIZER).collect(), whole)
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_alike_rows_are_dealt_to_all_groups(spark, whole):
    """Rows without an id and with one text, eight of which fill a sequence: they are many groups' work, and the rule leaves few bins open."""
    df = spark.createDataFrame([(None, "one two three " * 20)] * 400, "doc_id long, text string")
    rows = packing.assign(packing.pieces(df, TOKENIZER, 512), 512, per_group=20).collect()
    assert check(df, rows, whole, 512) <= 1.1 * 50
    placed = packing._round(spark.range(1000).selectExpr("id as row", "61L as length"), 50, 1, 512, 512)
    assert placed.selectExpr("sequence_id >> 32 as g").groupBy("g").count().agg(F.max("count")).first()[0] < 50


def test_groups_are_packed_by_the_rule_again_and_again():
    rng = np.random.default_rng(5)
    for n, size in ((0, 64), (1, 64), (300, 64), (2000, 2048)):
        lengths = rng.integers(1, size, n)
        bins, offsets, gaps = packing.pack_group(lengths, size)
        used = np.zeros(len(gaps), np.int64)
        for b, o, length in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True)):
            assert used[b] == o
            used[b] += length
        assert (size - used == gaps).all() and (used > 0).all()
        assert len(gaps) <= len(packing.sum_of_squares(np.sort(lengths)[::-1].tolist(), size)[2])


def test_ids_of_odd_texts(whole):
    texts = ["İstanbul ΣΑΣ", "a\x1cb\x85c", "it's 'tis don't we'll I'd", "x<|endoftext|>y", "½ ² ª º µ", "é e\u0301", "A_B-c...!! 123 १२", "ŉ ǅ ſ", "“q” – …€", "\u200b \xa0 \xad", "a" * 5000, "?!" * 400]
    t = packing.WordTokenizer(TOKENIZER)
    for _ in range(2):
        got = t.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_every_plain_character_splits_as_the_tokenizer_does(whole):
    plain = [chr(c) for c in range(0x3000) if packing.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 300
    texts = [f"a{c}b {c}1{c} {c}{c}s" for c in plain]
    got = packing.WordTokenizer(TOKENIZER).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    size = 50
    lengths = rng.integers(1, size + 1, 300).tolist()
    bins, offsets, gaps = packing.sum_of_squares(lengths, size)
    counts, left = np.zeros(size + 1, int), {}
    for n, b in zip(lengths, bins, strict=True):
        def cost(moved_from, to):
            c = counts.copy()
            if moved_from:
                c[moved_from] -= 1
            c[to] += 1
            return (c[1:] ** 2).sum() if to else (c[1:] ** 2).sum()

        choices = [cost(g, g - n) for g in range(n, size + 1) if counts[g]] + [cost(0, size - n)]
        mine = cost(left[b], left[b] - n) if b in left else cost(0, size - n)
        assert mine == min(choices)
        gap = left.get(b, size)
        if b in left:
            counts[gap] -= 1
        left[b] = gap - n
        counts[gap - n] += gap > n
    assert [left[b] for b in range(len(gaps))] == gaps


def test_packed_ids_round_trip(docs, whole):
    twins = docs.limit(20).unionByName(docs.limit(20).withColumn("text", F.upper("text")))
    rows = packing.packed_ids(docs.limit(20), TOKENIZER).collect()
    both = packing.packed_ids(twins, TOKENIZER).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in both)
    check(twins, both, whole)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        ids = [*whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert list(r["ids"]) == ids[r["start"] : r["start"] + r["length"]]
