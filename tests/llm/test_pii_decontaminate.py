from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillframe.llm import decontaminate, pii, registry

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_base(text):
    out = []
    for at, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), at, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TEXTS = [
    None,
    "",
    "a@b.c",
    "x.y+z@mail.example.com, é😀 q@w.e.r-t. @a.b a@b a@b..c a@b.c_d@e.f%g@h.i",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255 1.2.3 9999999999999999999999.1.1.1 0000000000000000000000001.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111, 4111111111111112 12 34 56 78 4111  1111",
    "+1 (017) 555-7713 +49.30.1234567 +1 2 +123456789 +1234567890123456 ++12 345 678 90",
    "é token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x 9807915762804490 y",
    "1 " * 20000,
    "a" * 100_000 + "@" + "b" * 1000,
    "a.b" * 30_000,
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["s"] for r in pii.personal_data(df).select("doc_id", pii.listed(F.col("base_spans")).alias("s")).collect()}
    assert got == {i: slow_base(t) for i, t in enumerate(TEXTS)}


def slow_redaction(text, spans):
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_long_texts_in_linear_time(spark):
    """A megabyte of addresses, numbers and tokens: places, what is around tokens, and redaction as by loops."""
    import time

    parts = ["user{0}@example.org, ", "10.0.{0}.7 ", "token = \"ab{0:038d}\" é😀 ", "word ", "4111 1111 1111 1111; ", "k9{0:012d}.q{0:013d} "]
    text = "".join(p.format(i % 200) for i in range(8000) for p in parts)
    df = spark.createDataFrame([(1, text), (2, text[:3000])], "doc_id long, text string")
    began = time.time()
    d = pii.with_base(df, "text", "base")
    rows = pii.with_candidates(d, "text", "base", "c").select("doc_id", "text", pii.listed(F.col("base")).alias("s"), "base", "c").collect()
    for r in rows:
        assert r["s"] == slow_base(r["text"])
        base = [(x["start"], x["end"]) for x in r["base"]]
        taken = bytearray(len(r["text"]))
        for a, b in base:
            taken[a:b] = b"1" * (b - a)
        want = [(m.start(), m.end(), m[0], r["text"][max(0, m.start() - 24) : m.start()], r["text"][m.end() : m.end() + 2]) for m in re.finditer(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{12,}", r["text"]) if not any(taken[m.start() : m.end()])]
        assert [tuple(x) for x in r["c"]] == want
    out = pii.redact(df, pii.Model()).collect()
    for r, o in zip(sorted(rows), sorted(out), strict=True):
        assert o["text"] == slow_redaction(r["text"], [(x["start"], x["end"], x["kind"]) for x in r["base"]])
    assert time.time() - began < 120


def test_reliabilities_and_weights_match_brute_force():
    """Expectation-maximisation and the logistic regression against the same steps over single votes, not counts."""
    import math
    import random

    rng = random.Random(4)
    votes = []
    for _ in range(300):
        truth = rng.random() < 0.4
        votes.append(tuple(rng.choices([1, 0, -1], [0.7, 0.2, 0.1] if truth else [0.1, 0.3, 0.6])[0] for _ in range(3)))
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    prior, table, posterior = pii.expectation_maximisation(counts, rounds=12)
    p = [min(0.95, max(0.05, 0.5 + sum(v) / 6)) for v in votes]
    for _ in range(12):
        own = (sum(p) + 1) / (len(p) + 2)
        rates = [{x: ((1 + sum(q for v, q in zip(votes, p, strict=True) if v[j] == x)) / (sum(p) + 3), (1 + sum(1 - q for v, q in zip(votes, p, strict=True) if v[j] == x)) / (len(p) - sum(p) + 3)) for x in (-1, 0, 1)} for j in range(3)]
        p = [own * math.prod(r[x][0] for r, x in zip(rates, v, strict=True)) / (own * math.prod(r[x][0] for r, x in zip(rates, v, strict=True)) + (1 - own) * math.prod(r[x][1] for r, x in zip(rates, v, strict=True))) for v in votes]
    assert prior == pytest.approx(own)
    assert all(table[j][x] == pytest.approx(rates[j][x]) for j in range(3) for x in (-1, 0, 1))
    assert all(posterior[v] == pytest.approx(q) for v, q in zip(votes, p, strict=True))
    rows = [(("a", "x"), 0.9, 30.0), (("a", "y"), 0.7, 10.0), (("b", "x"), 0.2, 20.0), (("b", "y"), 0.1, 40.0)]
    bias, weights = pii.logistic(rows, rounds=2000, decay=0.0)
    # At the optimum the errors sum to nothing for every value.
    for j, value in ((0, "a"), (0, "b"), (1, "x"), (1, "y")):
        assert sum(n * (1 / (1 + math.exp(-bias - weights[0][v[0]] - weights[1][v[1]])) - share) for v, share, n in rows if v[j] == value) == pytest.approx(0, abs=0.05)


def test_query(spark, small, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in registry.op9_pii(spark, small).collect():
        base = slow_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(re.findall(rf"\b{k}:", base)) for k in PATTERNS]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_method_finds_secrets_and_leaves_numbers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").rlike("[0-9]"))
    rows = pii.with_spans(docs.select("doc_id", "text"), pii.fit(docs), "text", "b", "s").select("text", pii.listed(F.col("s")).alias("s")).collect()
    secrets = found = 0
    for r in rows:
        want = [(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"])]
        got = [tuple(map(int, x.split(":")[1:])) for x in r["s"].split(",") if x.startswith("secret")]
        secrets += len(want)
        found += len(set(want) & set(got))
        assert not [r["text"][a:b] for a, b in got if r["text"][a:b].isdigit()]
    assert secrets and found >= 0.95 * secrets


def test_redaction_and_odd_rows(spark, odd, none):
    assert pii.personal_data(odd).count() == odd.count()
    assert pii.personal_data(none).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and sorted(map(repr, out.collect())) == sorted(map(repr, odd.collect()))
    df = spark.createDataFrame([(0, "é a@b.c +1 (017) 555-7713, ip 1.2.3.4", 40)], "doc_id long, text string, n_chars long")
    row = pii.redact(df).first()
    assert row["text"] == "é [EMAIL] [PHONE], ip [IP]" and row["n_chars"] == len(row["text"])
    df = spark.createDataFrame([(0, "+4111 1111 1111 111 1.2.3.4")], "doc_id long, text string")
    assert "4111" not in pii.redact(df).first()["text"] or not slow_base("+4111 1111 1111 111 1.2.3.4")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_hits(docs, bench):
    windows = []
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, items = set(), set()
        at = {n: {} for n in {len(g) for _, g in windows}}
        for n in at:
            for i in range(len(w) - n + 1):
                at[n].setdefault(tuple(w[i : i + n]), []).append(i)
        for item, g in windows:
            for i in at[len(g)].get(g, ()):
                hit |= set(range(i, i + len(g)))
                if item is not None:
                    items.add(str(item))
        out.append(repr((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))))
    return sorted(out)


def test_contamination_query(spark, small, docs):
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in registry.op10_decontamination(spark, small).collect()) == slow_hits(rows, bench)


@pytest.mark.parametrize("most, bits", [(0, 23), (64 << 20, 23), (64 << 20, 6)])
def test_odd_contamination(spark, odd, none, monkeypatch, most, bits):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 6)
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "CHUNK", 7)
    bench = [(1, "A b, C d e f G h i j k"), (2, "one"), (11, "ONE"), (None, "another text"), (3, None), (4, "..."), (5, "word word word"), (1, "a b c d e f g h i j k")]
    b = spark.createDataFrame([(*x, "g") for x in bench], "item_id long, text string, gram string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(70, "x word word word word y one-two")]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, words string")
    assert sorted(repr(tuple(r)) for r in decontaminate.contamination(df, b).collect()) == slow_hits(rows, bench)
    kept = decontaminate.drop_contaminated(df, b)
    clean = [r for r, h in zip(rows, [eval(x) for x in (slow_hits([r], bench)[0] for r in rows)], strict=True) if not h[-1]]
    assert sorted(repr(tuple(r)[:2]) for r in kept.collect()) == sorted(map(repr, clean))
    assert decontaminate.contamination(none, b).count() == 0
    assert {r["contaminated"] for r in decontaminate.contamination(df, b.limit(0)).collect()} == {False}
