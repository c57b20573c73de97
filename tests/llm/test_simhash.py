from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillframe.llm import common, simhash
from quillframe.llm.common import connected_components


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def expected(rows):
    fps = [slow_fingerprint(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    return sorted(map(repr, zip(ids, [f"{f:016x}" for f in fps], slow_components(fps, ids), strict=True)))


def test_documents_match_brute_force(docs):
    rows = docs.collect()
    assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == expected(rows)


def test_odd_rows(odd, none):
    assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(odd).collect()) == expected(odd.collect())
    assert simhash.near_duplicates(none).count() == 0


def near_codes(n, seed):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(n)]
    out = set(centers)
    for c in centers:
        for _ in range(6):
            x = c
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5, 6])):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bound", [simhash.SLICE, 3000])
def test_links_connect_what_brute_force_does(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "SLICE", bound)
    codes = near_codes(30, bound)
    found = [simhash.collide(np.array(codes, np.uint64), np.full(len(codes), 2), np.zeros(len(codes), np.uint64), 64, 4)] if bound < 10000 else []
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    if not found:
        found = [np.array([[r[0], r[1]] for r in simhash.links(df).collect()], np.int64).view(np.uint64)]
    at = {c: i for i, c in enumerate(codes)}
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found[0].tolist():
        parent[find(at[a])] = find(at[b])
    got = [find(i) for i in range(len(codes))]
    want = slow_components(codes, list(range(len(codes))))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain_and_a_hub(spark):
    rng = random.Random(1)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {1000 + i: 1000 for i in range(1, 300)}


def test_one_row_of_each_component_stays(docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        kept = simhash.drop_near_duplicates(df)
        assert kept.columns == df.columns
        fps = [slow_fingerprint(r["text"]) for r in rows]
        groups = slow_components(fps, list(range(len(rows))))
        got = kept.collect()
        assert len(got) == len(set(groups))
        of = {repr(tuple(r)): g for r, g in zip(rows, groups, strict=True)}
        assert sorted(of[repr(tuple(r))] for r in got) == sorted(set(groups))


@pytest.mark.parametrize("per_prefix", [2, 40])
def test_split_prefixes_and_hot_keys(spark, docs, monkeypatch, per_prefix):
    """Prefixes split before the shuffle and keys joined as hot ones change no result."""
    monkeypatch.setattr(simhash, "PER_PREFIX", per_prefix)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "HOT_SHARE", 1 << 30)
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(twice).collect()) == expected(twice.collect())


def test_of_rows_alike_in_id_and_text_the_same_one_stays(spark, monkeypatch):
    rows = [(1, "a b c d e", f"s{i}") for i in range(20)] + [(2, "a b c d e", "t"), (3, "quite another text here", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {tuple(r) for r in simhash.drop_near_duplicates(df).collect()}
    assert got == {tuple(r) for r in simhash.drop_near_duplicates(df.orderBy(F.desc("source"))).collect()}
    assert sorted(r[0] for r in got) == [1, 3]
    monkeypatch.setattr(simhash, "MOST_BROADCAST", 0)
    assert got == {tuple(r) for r in simhash.drop_near_duplicates(df).collect()}
