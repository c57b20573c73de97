"""Composite operators against plain loops, and on odd rows."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from statistics import median

import pytest

from quillframe.operators import composites
from quillframe.plans import composites as plans
from quillframe.plans import registry
from quillframe.plans.tables import Tables
from quillframe.sources import models

SMALL = "/root/testdata/sf0.001"


def by_page(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["ord"]):
        out[r["doc_id"], r["page"]].append(r)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def shown(text):
    return re.sub(r"\s", "", text or "")


def test_paragraphs_match_a_plain_loop(spark):
    want = []
    for page, lines in by_page(plans.loose_lines(Tables(spark, SMALL)).collect()).items():
        made = []
        for x in lines:
            box, size, on = [x["x0"], x["y0"], x["x1"], x["y1"]], x["size"] or 10.0, False
            if made and made[-1][1] == x["label"] and x["label"] in ("paragraph", "list"):
                p = made[-1][2]
                on = abs(box[0] - p[0]) < 3 * size and -0.5 * size < box[1] - p[3] < 0.8 * size
                on = on and (x["label"] == "list" or not (box[0] > p[0] + 0.5 * size or p[2] < box[2] - 2 * size))
            if on:
                made[-1][2] = [min(p[0], box[0]), min(p[1], box[1]), max(p[2], box[2]), max(p[3], box[3])]
                made[-1][3] += "\n" + x["text"]
            else:
                made.append([x["ord"], x["label"], box, x["text"]])
        want += [(*page, o, label, *map(float, box), text) for o, label, box, text in made]
    got = [tuple(r) for r in registry.queries()["paragraphs_of_lines"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert {text.count("\n") for *_, text in want} >= {0, 1, 2}


def test_page_char_errors_match_a_plain_loop(spark):
    t = Tables(spark, SMALL)
    found, truth, want = by_page(plans.found_elements(t).collect()), by_page(t.gt.collect()), {}
    around = lambda e, x, y: e["x0"] <= x <= e["x1"] and e["y0"] <= y <= e["y1"]
    for page in found.keys() | truth.keys():
        out = [e for e in truth[page] if e["label"] in ("table", "figure", "math")]
        blocks = [e for e in truth[page] if e["label"] not in ("table", "figure", "math") and e["text"]]
        own, extra = defaultdict(list), 0
        for e in found[page]:
            texts = [x for x in e["text"].split("\n") if shown(x)]
            for k, text in enumerate(texts):
                h = (e["y1"] - e["y0"]) / len(texts)
                x, y = (e["x0"] + e["x1"]) / 2, e["y0"] + h * (k + 0.5)
                if any(around(b, x, y) for b in out):
                    continue
                hits = [i for i, b in enumerate(blocks) if around(b, x, y)]
                if hits:
                    own[min(hits, key=lambda i: (blocks[i]["x1"] - blocks[i]["x0"]) * (blocks[i]["y1"] - blocks[i]["y0"]))].append((y, e["ord"], k, e["x0"], h, text))
                else:
                    extra += len(shown(text))
        errors = chars = 0
        for i, b in enumerate(blocks):
            rows, lines = [], sorted(own[i])
            for x in lines:
                if rows and x[0] - rows[-1][-1][0] <= median(y[4] for y in lines) / 2:
                    rows[-1].append(x)
                else:
                    rows.append([x])
            text = "".join(x[5] for row in rows for x in sorted(row, key=lambda x: x[3]))
            errors += distance(shown(b["text"]), shown(text))
            chars += len(shown(b["text"]))
        if blocks or extra:
            want[page] = (errors + extra, chars, extra)
    got = {(r["doc_id"], r["page"]): (r["errors"], r["chars"], r["extra_chars"]) for r in registry.queries()["page_char_errors"](spark, SMALL).collect()}
    assert got == want
    assert any(e for e, *_ in want.values()) and any(x for *_, x in want.values())


def test_inputs_are_put_in_place(spark):
    mains = spark.createDataFrame([(1, r"a\input{x}b\input{tex/y.tex}"), (2, "none"), (3, ""), (4, r"\input{x.bak}\input{x}"), (None, r"\input{x}")], "doc long, text string")
    files = spark.createDataFrame([(1, "x", r"[\input{z.tex}]"), (1, "z", "Z"), (1, "tex/y.tex", "Y\\\n"), (4, "x.tex", ""), (None, "x", "n"), (5, "unused", r"\input{nowhere}")], "doc long, name string, text string")
    got = {r["doc"]: r["text"] for r in composites.inline_inputs(mains, files, ["doc"]).collect()}
    assert got == {1: "a[Z]bY\\\n", 2: "none", 3: "", 4: "", None: "n"}
    assert composites.inline_inputs(mains.limit(0), files, ["doc"]).count() == 0
    with pytest.raises(Exception, match="no file"):
        composites.inline_inputs(mains, files.where("doc = 4"), ["doc"]).collect()
    loop = spark.createDataFrame([(1, "x", r"\input{x}")], "doc long, name string, text string")
    with pytest.raises(ValueError, match="deeper"):
        composites.inline_inputs(mains.where("doc = 1").selectExpr("doc", r"'\\input{x}' as text"), loop, ["doc"], deepest=3)


def test_blanks_take_the_owner_that_is_on_both_sides(spark):
    def owners(ids):
        rows = [(1, i, None if x == "-" else " " if x in "_ " else "c", None if x in "-_ ." else int(x)) for i, x in enumerate(ids)]
        got = composites.char_owners(spark.createDataFrame(rows, "line int, i int, c string, id int"), ["line"], "i", "c", "id").orderBy("i").collect()
        return "".join("." if r["id"] is None else str(r["id"]) for r in got)

    assert owners("1_1") == "111" and owners("1_-1_2_") == "1111.2." and owners("1_._1") == "1...1" and owners("_1") == ".1"


def test_labels_of_odd_blocks(spark):
    schema = "doc_id long, page int, ord int, kind string, text string, n_rows int, font string, size double, bold boolean, mono_ratio double, math_ratio double, list_head boolean, x0 double, y0 double, x1 double, y1 double, caption boolean, role string, label string"
    row = lambda o, text, kind="text", rows=1, size=10.0, y0=300.0, page=1, bold=False, font="f", role=None, mono=0.0: (1, page, o, kind, text, rows, font, size, bold, mono, 0.0, False, 0.0, y0, 100.0, y0 + 10, False, role, "mine")
    rows = [row(0, "body text " * 30, rows=9), row(1, None), row(2, "", size=None), row(3, "1.2 Bold", bold=True), row(4, "１．２　Bold", bold=True), row(5, "Large", size=14.0), row(6, "Larger", size=11.6), row(7, "— iv —", y0=950.0), row(8, "Head", y0=100.0), row(9, "Head", y0=100.0, page=2), row(10, "Once", y0=100.0, page=2), row(11, "x", kind="figure"), row(12, "def f():", mono=0.6, font=None), row(13, "T", role="title"), row(14, "1.2 Other font", font="g")]
    df = spark.createDataFrame(rows, schema)
    got = {r["ord"]: (r["label"], r["level"]) for r in composites.hybrid_labels(df, 200, 1000).collect()}
    assert got == {0: ("paragraph", None), 1: ("paragraph", None), 2: ("paragraph", None), 3: ("heading", 2), 4: ("paragraph", None), 5: ("heading", 1), 6: ("heading", 2), 7: ("other", None), 8: ("other", None), 9: ("other", None), 10: ("paragraph", None), 11: ("figure", None), 12: ("code", None), 13: ("title", None), 14: ("heading", 2)}
    assert composites.hybrid_labels(df.limit(0), 200, 1000).count() == 0


def continues(group, kind, r, body):
    """Whether row r goes on the block of the rows in group."""
    p, first = group[-1], group[0]
    x0, x1 = min(g["x0"] for g in group), max(g["x1"] for g in group)
    cols = {g["col"] for g in group}
    col = cols.pop() if len(cols) == 1 else 0
    reach = 3 * body if kind == "math" else 0
    if not (r["x0"] < x1 + reach and r["x1"] > x0 - reach) or {col, r["col"]} == {1, 2}:
        return False
    gap = r["y0"] - p["y1"]
    if kind == "math":
        return -2 * body <= gap <= 1.2 * body and (r["kind"] == "math" or r["tiny"])
    if gap < -0.5 * body:
        return False
    unit, large = max(body, p["size"], r["size"]), max(p["size"], r["size"])
    if kind == "code":
        return r["kind"] == "code" and (gap <= 0.8 * unit or 0 < r["baseline"] - p["baseline"] <= 1.8 * large)
    fonts = {r["font"] or "", p["font"] or ""}
    if r["kind"] != "text" or large > 1.15 * min(p["size"], r["size"]) or (len(fonts) > 1 and "" not in fonts):
        return False
    if kind == "list":
        return gap <= (1.3 if r["head"] else 0.8) * unit and (r["head"] or r["x0"] > first["x0"] + 0.3 * body)
    return gap <= 0.8 * unit and not r["head"] and not r["indented"] and r["x0"] <= x0 + 0.5 * body


def test_row_groups_match_a_plain_loop(spark):
    want, kinds = set(), set()
    for page, rows in by_page(plans.rows_of_pages(Tables(spark, SMALL)).collect()).items():
        groups = []
        for r in rows:
            if groups and continues(groups[-1][1], groups[-1][0], r, 10):
                groups[-1][1].append(r)
            else:
                groups.append(("list" if r["kind"] == "text" and r["head"] else r["kind"], [r]))
        want |= {(*page, k, r["ord"]) for k, (_, group) in enumerate(groups) for r in group}
        kinds |= {kind for kind, group in groups if len(group) > 1}
    assert {tuple(r) for r in registry.queries()["row_groups"](spark, SMALL).collect()} == want
    assert kinds == {"text", "list", "code", "math"}


def test_code_is_indented_by_its_characters(spark):
    rows = ["12 if x:", "3    y = 1", "   ", "", "4", "z"]
    chars = [(1, r, i, c, 10.0 + 6 * i, 15.0 + 6 * i, 6.0 if i < 2 and c.isdigit() and r < 4 else 10.0) for r, line in enumerate(rows) for i, c in enumerate(line)]
    got = composites.reindented(spark.createDataFrame(chars, "block int, row int, i int, c string, x0 double, x1 double, size double"), ["block"]).collect()
    assert [(r["block"], r["text"]) for r in got] == [(1, "   if x:\n     y = 1\n4\nz")]


def test_registered_models_are_called(spark, tmp_path):
    rows = [{"id": "a", "name": "A", "entry": "tests.test_composites:upper", "input": "pdf", "outputs": ["bbox"], "params": {"mark": "!"}, "note": "n"}, {"id": "b", "name": "B", "entry": "m:f", "input": "image", "outputs": []}]
    put = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows))
    put("models.json", rows)
    got = {r["id"]: r for r in models.load_models(spark, f"file://{tmp_path}/models.json").collect()}
    assert got["b"]["params"] == {} and got["b"]["note"] == "" and got["a"]["outputs"] == ["bbox"]
    df = spark.createDataFrame([("x",), (None,)], "text string")
    assert [r["text"] for r in models.predict(df, got["a"]["entry"], got["a"]["params"]).collect()] == ["X!", None]
    for name, bad, message in (("twice.json", [rows[0], rows[0]], "model twice: a"), ("none.json", [{**rows[0], "entry": "os"}], "no entry: a")):
        put(name, bad)
        with pytest.raises(Exception, match=message):
            models.load_models(spark, f"file://{tmp_path}/{name}").collect()


def upper(df, mark):
    return df.selectExpr(f"concat(upper(text), '{mark}') as text")


def test_elements_of_regions(spark):
    text = [(1, "HEAD", 10), (2, "ab c", 50), (3, " de ", 70), (4, "  ", 90), (5, "wide", 110), (6, "7", 990)]
    chars = [(1, 10 * row + i, c, 100.0 * i, b - 9.0, 100.0 * i + 50, b + 3.0, float(b)) for row, line, b in text for i, c in enumerate(line)]
    chars.append((1, 29, None, 0.0, 0.0, 0.0, 0.0, 50.0))
    glyphs = spark.createDataFrame(chars, "page int, i int, c string, x0 double, y0 double, x1 double, y1 double, baseline double")
    rows = [(9, "hd", 10, 10, None, "other"), (8, "pn", 990, 990, None, "other"), (1, "block", 5, 75, None, None), (2, "block", 90, 90, None, "math"), (3, "wide", 110, 110, None, "title"), (4, "block", 50, 120, 1, "list"), (5, "block", 400, 500, None, "x")]
    regions = spark.createDataFrame([(1, *r[:5], 150, r[5]) for r in rows], 'page int, region int, kind string, top int, bottom int, "column" int, middle int, label string'.replace('"', "`"))
    got = [tuple(r) for r in composites.true_elements(glyphs, regions, ["page"], ["i"]).orderBy("place").collect()]
    assert got == [
        (1, 9, 1, "other", 0.0, 1.0, 350.0, 13.0, "HEAD"),
        (1, 1, 2, None, 0.0, 41.0, 350.0, 73.0, "ab c\nde"),
        (1, 3, 3, "title", 0.0, 101.0, 350.0, 113.0, "wide"),
        (1, 4, 4, "list", 200.0, 41.0, 350.0, 73.0, "c\ne"),
        (1, 8, 5, "other", 0.0, 981.0, 50.0, 993.0, "7"),
    ]
    assert composites.true_elements(glyphs.limit(0), regions, ["page"], ["i"]).count() == 0
