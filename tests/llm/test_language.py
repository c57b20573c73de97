from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from quillframe.llm import language, registry


def test_held_out_accuracy_and_columns(spark):
    out = registry.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)


def test_odd_rows(odd, none, docs):
    model = language.fit(docs)
    rows = language.predict(odd, model, keep=tuple(odd.columns), text="text").collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not language.has_letter(r["text"]):
            assert (r["lang_pred"], r["score_"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in model.languages and r["score"] in (7.0, 0.0, None)
    assert language.predict(none, model).count() == 0
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in odd.collect()}
    assert language.keep_identified(none).count() == 0
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(repr, language.keep_identified(bare).collect())) == sorted(map(repr, bare.collect()))


def test_sums_do_not_depend_on_slices(monkeypatch):
    import numpy as np

    table = np.random.default_rng(0).random((1 << 10, 3)).astype(np.float32)
    texts = ["Die tz.", "", None, "ab " * 500, "x", "é" * 300, "12 34"]
    a = language.subword_sums(texts, table)
    monkeypatch.setattr(language, "SLICE", 97)
    b = language.subword_sums(texts, table)
    assert np.allclose(a[0], b[0]) and (a[1] == b[1]).all()
    one = [language.subword_sums([t], table) for t in texts]
    assert np.allclose(a[0], np.concatenate([x[0] for x in one]))


def test_sample_is_bounded(docs):
    rows = docs.select(F.col("lang").alias("label"), F.col("doc_id").cast("string").alias("id"), "text")
    s = language.Settings(sample=40)
    got = language.sample(rows, s)
    assert 0 < len(got) <= 1.5 * 40 + 100
    whole = {r["text"] for r in docs.collect()}
    assert all(t in whole for t, _ in got)
    assert got == language.sample(rows, s) == language.sample(rows.repartition(7, "text"), s)
    one = rows.withColumn("id", F.lit("same"))
    assert 0 < len(language.sample(one, s)) <= 1.5 * 40 + 100
    assert pytest.approx(len({x for _, x in got}), abs=3) == 4


OTHER = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными в своём достоинстве и правах.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van."]
JUNK = ["xqzv jkwpt qqzx vbnmk wrtzp", "asdf qwer zxcv hjkl", "zzzzzzzzzz qqqqqq", "Bcdfg hjklm npqrs tvwxz"]


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_other_languages_and_junk_are_rejected_and_clean_texts_stay(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = language.fit(docs, learn)
    assert not model.predict(OTHER + JUNK)[2].any()
    held = [r["text"] for r in docs.where(~learn).where(F.col("text").rlike(r"\p{L}")).orderBy("doc_id").limit(800).collect()]
    short = [" ".join(t.split()[:n]) for t in held for n in (2, 5, 9)]
    assert model.predict(held)[2].mean() >= 0.99
    assert model.predict([t for t in short if language.has_letter(t)])[2].mean() >= 0.99


def test_too_many_labels_are_an_error(spark):
    rows = spark.range(257).selectExpr("cast(id as string) as id", "concat('l', id) as label", "'some text' as text")
    assert language.sample(rows.where("id < 256"), language.Settings())
    with pytest.raises(ValueError, match="256 labels"):
        language.sample(rows, language.Settings())


def slow_subwords(text):
    """The hashed buckets of a text's subwords by the definition: 2 to 4 bytes within a word and its borders."""
    out = []
    for word in "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.lower()).split(" "):
        data = b" " + word.encode() + b" "
        for size in (2, 3, 4) if word else ():
            for i in range(len(data) - size + 1):
                part = data[i : i + size]
                code = int.from_bytes(part, "big")
                code = (code + size * 0x3C6EF372) * 0x9E3779B1 % 2**32
                code = (code ^ code >> 15) * 0x85EBCA77 % 2**32
                out.append(code >> 16)
    return out


def test_predictions_match_brute_force(docs):
    """Subwords, averages, softmax and rejection by loops over the same model."""
    import math

    model = language.fit(docs)
    texts = [r["text"] for r in docs.where(F.col("text").rlike(r"\p{L}")).orderBy("doc_id").limit(60).collect()] + ["a", "É!", "x y Straße 12", "ab" * 3000]
    langs, scores, accepted = model.predict(texts)
    for text, lang, score, ok in zip(texts, langs, scores, accepted, strict=True):
        at = slow_subwords(text)
        mean = [sum(float(model.logits[b, c]) for b in at) / len(at) for c in range(len(model.languages) + 1)]
        odds = [(m + b) / model.temperature for m, b in zip(mean, model.bias, strict=False)]
        top = max(odds)
        share = [math.exp(o - top) for o in odds]
        best = max(range(len(share)), key=share.__getitem__)
        assert (lang, score) == (model.languages[best], pytest.approx(share[best] / sum(share), abs=1e-6))
        if abs(score - model.threshold) > 1e-5 and abs(mean[-1] - model.known) > 1e-5:
            assert ok == (score >= model.threshold and mean[-1] >= model.known)


def test_learning_lowers_the_loss_to_what_was_taught():
    texts = [f"{w} {v}" for w in ("alpha", "beta", "gamma") for v in ("one", "two", "three", "four", "five", "six")] * 4
    texts += [f"{w} {v}" for w in ("крот", "мышь", "лиса") for v in ("раз", "два", "три", "пять", "семь", "сто")] * 4
    model = language.train(texts, ["en"] * 72 + ["ru"] * 72, language.Settings())
    assert model.predict(["beta six", "мышь сто", "alpha"])[0] == ["en", "ru", "en"]
