"""Operators against hand-computed results and plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillframe.functions import tables, text
from quillframe.functions.geometry import Box, iou
from quillframe.operators import documents, grouping, matching
from quillframe.operators.validation import document_problems, element_problems, run_problems, table_problems

BOXES = "doc_id long, page int, ord int, x0 double, y0 double, x1 double, y1 double"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_iou(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.4, 0.4, 0.2, 0.2, 0.6, 0.6), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    got = [r[0] for r in df.select(iou(Box.of("a"), Box.of("b"))).collect()]
    assert got == [pytest.approx(0.04 / 0.28), 0.0]


def test_greedy_matching_is_the_sequential_one(spark):
    rng = random.Random(3)
    rows = {side: [(0, p, i, float(x := rng.randrange(6)), float(y := rng.randrange(6)), x + 6.0, y + 6.0) for p in range(20) for i in range(8)] for side in "pg"}
    got = {(r["page"], r["i"], r["j"]) for r in matching.match(*(spark.createDataFrame(rows[s], BOXES) for s in "pg"), ["doc_id", "page"]).collect()}

    def value(a, b):
        w = max(0, min(a[5], b[5]) - max(a[3], b[3]))
        h = max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / (72 - w * h)

    want = set()
    for p in range(20):
        one, two = [[r for r in rows[s] if r[1] == p] for s in "pg"]
        used = set()
        for s, i, j in sorted(((value(a, b), a[2], b[2]) for a in one for b in two), reverse=True):
            if s >= 0.5 and ("p", i) not in used and ("g", j) not in used:
                used |= {("p", i), ("g", j)}
                want.add((p, i, j))
    assert got == want


def test_text_errors(spark):
    rng = random.Random(5)
    pairs = [("見出しA", "見出しB"), ("x^{2}", "x^{3}"), (r"\frac{a}{b} & \alpha", r"\frac{a}{c}\beta"), ("", "ab"), ("x", r"\aax")]
    pairs += [("".join(rng.choice(["a", "\\ab", " ", "b", "é"]) for _ in range(30)), "".join(rng.choice(["a", "\\ab", " ", "b", "é"]) for _ in range(25))) for _ in range(20)]
    df = spark.createDataFrame(pairs, "g string, p string")
    import re

    tokens = lambda t: [x for x in re.findall(r"\\[a-zA-Z]+|\\.|\S", t) if x != "&"]
    for r, (g, p) in zip(df.select(text.char_errors(F.col("g"), F.col("p")).alias("c"), text.token_errors(F.col("g"), F.col("p")).alias("t")).collect(), pairs, strict=True):
        a, b = ("".join(x.split()) for x in (g, p))
        assert tuple(r["c"]) == (edit(a, b), len(a))
        assert tuple(r["t"]) == (edit(tokens(g), tokens(p)), len(tokens(g)))


def test_table_comparisons(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "x"], [None, 0.24, None], [None, 0.25, 0.3]), (["a"], None, [0.1], [0.2])], "g array<string>, p array<string>, w array<double>, v array<double>")
    n, right = tables.widths_right(F.col("w"), F.col("v"), 0.03)
    assert [tuple(r) for r in df.select(tables.same_places(F.col("g"), F.col("p")), n, right).collect()] == [(1, 2, 1), (0, 1, 0)]


def test_captions_take_free_neighbours(spark):
    rows = [(0, 1, 1, "caption", "Table 1"), (0, 1, 2, "table", ""), (0, 1, 3, "caption", "Figure 1"), (0, 1, 4, "figure", ""), (0, 1, 5, "paragraph", ""), (0, 1, 6, "caption", "Figure 2")]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord int, label string, text string")
    got = {r["ord"]: r["target"] for r in documents.attach_captions(df, ["doc_id", "page"]).collect()}
    assert got == {1: 2, 3: 4, 6: None}


def test_boxes_merge_until_none_are_near():
    rng = random.Random(2)
    boxes = [(x := rng.randrange(100), y := rng.randrange(100), x + 5, y + 5) for _ in range(40)]
    slow = list(boxes)
    while True:
        found = next(((a, b) for i, a in enumerate(slow) for b in slow[:i] if grouping.near(a, b, 4)), None)
        if not found:
            break
        slow.remove(found[0])
        slow.remove(found[1])
        slow.append(grouping.hull(*found))
    assert grouping.merged(boxes, 4) == sorted(slow)
    assert grouping.closure([(0, 0, 1, 1), (9, 9, 10, 10), (2, 2, 3, 3)], 1) == [0, 1, 0]
    assert grouping.blocks([(0, 0, 50, 10), (0, 12, 50, 22), (0, 60, 50, 70), (80, 72, 99, 82)]) == [0, 0, 1, 2]


def test_problems(spark):
    e = spark.createDataFrame([("text", 0, 0, 1, 1, "a", "heading", 2), ("box", 2, 0, 1, 1, None, "verse", 5)], "kind string, x0 int, y0 int, x1 int, y1 int, text string, label string, level int")
    assert [len(r[0]) for r in e.select(element_problems()).collect()] == [0, 4]
    d = spark.sql("select 4 v, array(named_struct('page', 1, 'width', 1.0, 'height', 1.0, 'unit', 'pt')) p union all select 9, array(named_struct('page', 2, 'width', 0.0, 'height', 1.0, 'unit', 'in'))")
    assert sorted(len(r[0]) for r in d.select(document_problems(F.col("v"), F.col("p"))).collect()) == [0, 4]
    r = spark.sql("select 'ab' t, array(named_struct('text', 'a', 'tex', cast(null as string)), named_struct('text', 'b', 'tex', 'x')) r union all select 'ab', array(named_struct('text', '', 'tex', ' '))")
    assert sorted(len(x[0]) for x in r.select(run_problems(F.col("t"), F.col("r"))).collect()) == [0, 3]
    t = spark.sql("select array(array('a', 'b'), array('c')) c, array('l', 'c') a, array(true, true, true) k, array(true, true, true) r, array(0.5D, null) w union all select array(array('a')), array('x', 'l'), array(true), array(true), array(2.0D)")
    assert sorted(len(x[0]) for x in t.select(table_problems(*(F.col(c) for c in "cakrw"))).collect()) == [0, 5]


def test_formulas_in_one_form(spark):
    cases = {
        r"x_i^2 \le y": r"x _ { i } ^ { 2 } \leq y",
        r"a \, & \quad b^{n}": r"a b ^ { n }",
        r"x^^y_": r"x ^ { ^ } y _",
        r"\ne\rightarrow": r"\neq \to",
        "": "",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string")
    rows = df.select("i", F.array_join(text.normal_tokens(text.tex_tokens(F.col("t"))), " ").alias("n"), text.detokenize(text.tex_tokens(F.col("t"))).alias("d")).orderBy("i").collect()
    assert [r["n"] for r in rows] == list(cases.values())
    assert [r["d"] for r in rows] == [r"x_i^2\le y", r"a\,&\quad b^{n}", "x^^y_", r"\ne\rightarrow", ""]
