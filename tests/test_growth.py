"""Steps that took more than their input's share: what they must not do again, and that their results stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.functions import text
from quillframe.operators import blocks, characters, composites
from quillframe.plans import registry

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_a_tables_columns_are_counted_once(spark):
    shown = plan(spark, "table_blocks")
    assert shown.count("array_max(") <= 1 and shown.count("(?<=[A-Za-z0-9])") <= 1


def test_white_space_at_ends_is_that_of_the_pattern(spark):
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(f"{c}x y{c}",) for c in every] + [("",), (" \n",), (None,)], "t string")
    pattern = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
    assert df.where(~text.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", pattern, ""))).count() == 0
    assert {len(r[0]) for r in df.where("t is not null").select(text.strip(F.col("t"))).collect()} == {0, 3, 5}


def test_distance_is_levenshteins(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab\u3000c") for _ in range(rng.choice((0, 1, 3, 9, 40, 90))))
    pairs = [(word(), word()) for _ in range(150)] + [(a + b, a + c + b) for a, b, c in ((word(), word(), word()) for _ in range(60))] + [("\U0001f600x", "x"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("n"))
    assert all(text.distance(r["a"], r["b"]) == r["n"] for r in df.collect())


def test_a_page_meets_its_elements_in_one_row(spark):
    shown = plan(spark, "page_char_errors")
    assert "Join" not in shown and "levenshtein" not in shown and "MapInArrow" in shown


def test_last_places_of_a_groups_characters():
    lines = pa.RecordBatch.from_pydict({"text": ["abA", "b~", "", "xaé", "aa"], "doc_id": [1, 1, 1, None, None], "ord": [0, 4, 9, 2, 1]})
    c = characters.Chars(lines, lines.column("text"))
    line, code, i = characters.last_places(c, characters.groups_of(lines, ["doc_id"]), c.of("ord"), c.code != ord("A"))
    assert sorted(zip(line.tolist(), map(chr, code), i.tolist(), strict=True)) == [(0, "a", 0), (1, "b", 0), (1, "~", 1), (3, "a", 1), (3, "x", 0)]
    none = lines.slice(0, 0)
    assert len(characters.last_places(characters.Chars(none, none.column("text")), characters.groups_of(none, ["doc_id"]), np.zeros(0), np.zeros(0, bool))[0]) == 0


@pytest.mark.parametrize("name", ["fixed_pitch_fonts", "glyph_ratios"])
def test_no_row_a_character(spark, name):
    shown = plan(spark, name)
    assert "MapInArrow" in shown and "regexp_extract_all" not in shown


def test_tokens_are_counted_once_and_not_beyond_the_last_bucket(spark):
    rows = ["", " \u3000", "x" * 9, "x " * 10, "\\alpha\\beta" * 5, "\\", "\\\n", "\\\\" * 50, "\\ab " * 51, "\x85é\x1cé" * 25, "\\\r" * 50, "\\\U0001f600" * 50, "\\\n" * 50, "\\\n" * 51]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for n, whole in df.select(text.tex_token_count(F.col("t"), 50), F.size(text.tex_tokens(F.col("t")))).collect():
        assert n == min(whole, 51)
    assert plan(spark, "token_bucket_accuracy").count("regexp_extract_all(") == 1


def test_token_sets_are_those_of_the_pattern(spark):
    rows = ["", "\\", "a\\", "\\\n", "\\\\a", "\\ab1\\c\\,", "\\\r\\\x85", "x \u3000\x1cy\U0001f600\\\U0001f600", "\\\\\\alpha", "no commands, none"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for t, tokens in df.select("t", text.tex_tokens(F.col("t"))).collect():
        assert text.tex_token_set(t) == (len(tokens), set(tokens))
    shown = plan(spark, "tex_token_scope")
    assert "regexp_extract_all" not in shown and "MapInArrow" in shown


def test_texts_are_joined_and_mended_as_columns_are(spark):
    rows = ["", "\n", "a \n b", "a-\nb", "あ\u3000\n\x1cい", "x\x0b\x1fy\x88\x9f", "\x85 a\t", "1\n\n2\n", "\x0b\nfi", "\x00\x7f"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for t, one, other in df.select("t", text.join_wrapped(F.col("t")), text.fix_controls(F.col("t"))).collect():
        assert (blocks.joined(t), blocks.mended(t)) == (one, other)


def test_a_document_meets_its_elements_in_one_row(spark):
    shown = plan(spark, "document_blocks")
    assert shown.count("Join") == 1 and "Window" not in shown and "MapInArrow" in shown


def test_sources_are_dealt_once(spark):
    shown = plan(spark, "inlined_sources")
    assert "Join" not in shown and "Union" not in shown and shown.count("RepartitionByExpression") == 1


def test_inputs_count_as_deep_as_they_nest(spark):
    parts = {f"{k}.tex": ["", f"{k + 1}.tex", ""] for k in range(3)} | {"3.tex": ["x"]}
    assert composites.put_in_place(r"\input{0}-\input{2.bak}", parts, 4) == "x-x"
    # The second is put together before it is met deeper.
    for text in (r"\input{0}", r"\input{2}\input{0}"):
        with pytest.raises(RecursionError, match="deeper"):
            composites.put_in_place(text, parts, 3)
