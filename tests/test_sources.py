"""Files, streams, titles and blocks against small hand-made cases and plain loops."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillframe.operators import grouping, ocr
from quillframe.plans import elements, registry
from quillframe.plans.tables import Tables
from quillframe.sources import documents, files
from quillframe.streaming import scoreboard

SMALL = "/root/testdata/sf0.001"
GOOD = {"source": "a", "extractor": "x", "ir_version": 2, "pages": [{"page": 1, "width": 10.0, "height": 20.0, "unit": "pt", "elements": [{"kind": "text", "bbox": [0.0, 0.1, 0.5, 0.2], "text": "見出し", "label": "heading", "level": 1, "runs": [{"text": "見出し", "bold": True}]}, {"kind": "table", "bbox": [0, 0, 1, 1], "cells": [["a", "b"], ["c"]]}]}]}


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_documents_are_read_and_checked(spark, tmp_path):
    put(tmp_path, "one/a.json", GOOD)
    put(tmp_path, "one/broken.json", "{\"source\": ")
    d = documents.load_documents(spark, f"{tmp_path}/one", check=True, files=True)
    assert [(r["source"], r["ir_version"]) for r in d.collect()] == [("a", 4)]
    e = documents.elements(d).orderBy("ord").collect()
    assert [(r["ord"], r["kind"], r["x1"], r["cells"]) for r in e] == [(0, "text", 0.5, None), (1, "table", 1.0, [["a", "b"], ["c"]])]
    assert e[0]["runs"][0]["bold"] is True and e[0]["runs"][0]["tex"] is None
    documents.save_json(d, f"{tmp_path}/out")
    back = documents.load_documents(spark, f"{tmp_path}/out")
    assert back.collect() == d.collect()
    line = next(p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size).read_text()
    assert "null" not in line and "見出し" in line
    put(tmp_path, "bad/b.json", GOOD | {"ir_version": 9})
    with pytest.raises(PySparkException, match="version is unknown"):
        documents.load_documents(spark, f"{tmp_path}/bad", check=True, files=True).collect()


def test_manifests_and_reports_skip_what_is_broken(spark, tmp_path):
    put(tmp_path, "sets/one/manifest.json", {"cases": [{"id": "c1", "tags": {"lang": "ja"}}, {"id": "c2", "tags": {}}]})
    put(tmp_path, "sets/two/notes.json", {"cases": [{"id": "no"}]})
    assert sorted((r["dataset"], r["case_id"], r["tags"]) for r in documents.cases(spark, f"{tmp_path}/sets").collect()) == [("one", "c1", {"lang": "ja"}), ("one", "c2", {})]
    for run, value in (("20250101-1_a_d", {"run_id": "20250101-1_a_d", "model": {"id": "a", "name": "A"}, "dataset": "d", "summary": {"f1": 0.5, "cer": None}}), ("20250102-1_b_d", {"run_id": "20250102-1_b_d", "model": {"id": "b", "name": "B"}, "dataset": "d", "summary": {}, "errors": 3}), ("20250103-1_c_d", "{not json"), ("20250104-1_d_d", {"run_id": "x"})):
        put(tmp_path, f"runs/{run}/report.json", value)
    (tmp_path / "runs/20250105-1_e_d").mkdir()
    r = documents.reports(spark, f"{tmp_path}/runs").orderBy(F.desc("run_id")).collect()
    assert [(x["model"]["id"], x["errors"]) for x in r] == [("b", 3), ("a", 0)]


def test_sample_pairs_and_tsv(spark, tmp_path):
    for name in ("ja/a.txt", "ja/a.jpg", "ja/a.png", "ja/b.txt", "en/a.txt", "en/a.JPEG", "en/c.png"):
        put(tmp_path, f"s/{name}", "x")
    got = {(r["category"], r["stem"], r["image"].rsplit("/", 1)[1]) for r in files.sample_pairs(spark, f"{tmp_path}/s").collect()}
    assert got == {("ja", "a", "a.png"), ("en", "a", "a.JPEG")}
    assert files.sample_pairs(spark, f"{tmp_path}/s", categories=["en"]).count() == 1
    put(tmp_path, "t.tsv", "a.png\t\\frac{1}{2}\tx\nb.png\t\n")
    assert sorted(tuple(r) for r in files.load_labels_tsv(spark, f"{tmp_path}/t.tsv").collect()) == [("a.png", "\\frac{1}{2}\tx"), ("b.png", "")]
    put(tmp_path, "u.tsv", "no tab here\n")
    with pytest.raises(PySparkException, match="no tab"):
        files.load_labels_tsv(spark, f"{tmp_path}/u.tsv").collect()
    put(tmp_path, "e.tsv", "")
    assert files.load_labels_tsv(spark, f"{tmp_path}/e.tsv").count() == 0


def test_scoreboard_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "id % 3 as k")
    rows.where("id < 6").write.parquet(f"{tmp_path}/in/1")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    first = scoreboard.run_available(spark, stream(), ["k"], ["id"], f"{tmp_path}/out")
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in scoreboard.totals(rows.where("id < 6"), ["k"], ["id"]).collect()}
    rows.where("id >= 6").write.parquet(f"{tmp_path}/in/2")
    for _ in range(2):
        whole = scoreboard.run_available(spark, stream(), ["k"], ["id"], f"{tmp_path}/out")
        assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in scoreboard.totals(rows, ["k"], ["id"]).collect()}


def slow_titles(rows, body):
    run = []
    for r in sorted(rows, key=lambda r: (r["y0"], r["ord"])):
        fits = abs((r["x0"] + r["x1"]) / 2 - 500) <= 50 and r["x1"] - r["x0"] <= 700 and len(r["text"]) <= 50 and "\n" not in r["text"]
        if run and (not fits or r["y0"] - run[-1]["y1"] > 2 * max(x["size"] for x in run)):
            break
        if fits:
            run.append(r)
    top = max((r["size"] for r in run), default=0)
    if not run or top < 1.3 * body:
        return {}
    start = next(i for i, r in enumerate(run) if r["size"] == top)
    return {r["ord"]: "title" if r["size"] == top else "date" if r["text"] == "2024/05/01" else "author" for r in run[start:]}


def test_titles_match_a_plain_loop(spark):
    pages, weight = defaultdict(list), defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in elements.titled(Tables(spark, SMALL)).collect():
        pages[r["doc_id"]].append(r)
    want = set()
    for doc, rows in pages.items():
        for r in rows:
            w = weight[doc][r["size"]]
            w[1] = w[1] if w[0] else -r["ord"]
            w[0] += len(r["text"])
            w[1] = max(w[1], -r["ord"])
        body = max(weight[doc], key=lambda s: weight[doc][s])
        want |= {(doc, i, role) for i, role in slow_titles(rows, body).items()}
    got = {tuple(r) for r in registry.queries()["title_roles"](spark, SMALL).collect()}
    assert got == want and {x[2] for x in got} >= {"title", "author"}


def test_lines_join_the_latest_block_that_they_continue():
    rng = random.Random(6)
    for _ in range(50):
        lines = sorted(((x := rng.randrange(3) * 40, y := i * 9 + rng.randrange(6), x + rng.choice([30, 60, 90]), y + rng.choice([8, 10, 14])) for i in range(20)), key=lambda b: b[1])
        members = []
        for b in lines:
            for m in reversed(members):
                p = m[-1]
                tall, low = max(b[3] - b[1], p[3] - p[1]), min(b[3] - b[1], p[3] - p[1])
                if b[1] - p[3] <= 0.8 * tall and tall / low <= 1.3 and min(p[2], b[2]) > max(p[0], b[0]) and b[0] - min(x[0] for x in m) < 0.8 * tall and b[2] - p[2] < 2 * tall:
                    m.append(b)
                    break
            else:
                members.append([b])
        got = defaultdict(list)
        for b, k in zip(lines, grouping.blocks(lines), strict=True):
            got[k].append(b)
        assert [got[k] for k in sorted(got)] == members


def test_words_that_count_make_paragraphs(spark):
    rows = [(1, 0, 1, 1, 1, "Hello", 90, 10, 10, 40, 10), (1, 1, 1, 1, 1, " world ", 80, 60, 11, 40, 12), (1, 2, 1, 1, 2, "次", 70, 10, 30, 10, 20), (1, 3, 1, 1, 2, "行", 70, 20, 30, 10, 20), (1, 4, 1, 2, 1, "gone", -1, 0, 0, 9, 9), (1, 5, 2, 1, 1, "  ", 90, 0, 0, 9, 9), (1, 6, 3, 1, 1, "flat", 90, 5, 5, 0, 9)]
    df = spark.createDataFrame(rows, "page int, ord int, block int, par int, line int, text string, conf int, left int, top int, width int, height int")
    got = [tuple(r) for r in ocr.word_elements(df, ["page"], F.lit(100.0), F.lit(200.0), 2.0).collect()]
    assert got == [(1, 0, 0.05, 0.025, 0.5, 0.125, "Hello world\n次行", 10.0, 0.775)]


def test_decorations_match_a_plain_loop(spark):
    from difflib import SequenceMatcher

    sums = defaultdict(lambda: [0, 0, 0])
    for r in Tables(spark, SMALL).gt.select("lang", "text").collect():
        g, p = ("".join("".join(w for i, w in enumerate(r["text"].split(" ")) if i % k).split()) for k in (3, 4))
        n = sum(b.size for b in SequenceMatcher(None, p, g, autojunk=False).get_matching_blocks())
        for at, x in enumerate((n, len(p), len(g))):
            sums[r["lang"]][at] += x
    got = {r["lang"]: [r["matched"], r["n_pred"], r["n_gt"]] for r in registry.queries()["decoration_scores"](spark, SMALL).collect()}
    assert got == sums


def test_captions_by_gap_match_a_plain_loop(spark):
    import re

    from quillframe.operators import matching

    rng = random.Random(8)
    boxes = "page int, ord int, x0 double, y0 double, x1 double, y1 double"
    targets = [(p, i, float(x := rng.randrange(4) * 30), float(y := rng.randrange(9) * 20), x + 40.0, y + 15.0) for p in range(30) for i in range(5)]
    texts = [(p, i, float(x := rng.randrange(4) * 30), float(y := rng.randrange(9) * 20 + 16), x + 40.0, y + 5.0, rng.choice(["図１ あ", "Table 2", "表", "plain", "Fig.3" + "x" * 150])) for p in range(30) for i in range(10, 18)]
    want = set()
    for p in range(30):
        used = set()
        for t in sorted(x for x in targets if x[0] == p):
            near = [(gap, c[1]) for c in texts if c[0] == p and c[1] not in used and re.match(r"(図|表|Figure|Fig\.|Table)\s*\d+", c[6]) and len(c[6]) <= 150 and min(t[4], c[4]) > max(t[2], c[2]) and -2 <= (gap := max(c[3] - t[5], t[3] - c[5])) < 40]
            if near:
                used.add(min(near)[1])
                want.add((p, t[1], min(near)[1]))
    got = {tuple(r) for r in matching.captions_by_gap(spark.createDataFrame(targets, boxes), spark.createDataFrame(texts, boxes + ", text string"), ["page"], 10.0).collect()}
    assert got == want and len(got) > 20


def slow_blocks(rows):
    """The blocks of one document by a loop over its elements in order."""
    import re

    space = r"[\s\x1c-\x1f]"
    marks = {"paren": r"[(（]\d+[)）]", "number": r"\d+[.．)）]", "dot": r"・", "bullet": r"[•●◦▪*]", "dash": rf"[-–—−‐](?={space})"}

    def joined(text):
        out = ""
        for line in (x.strip() for x in text.split("\n")):
            if out and line and re.fullmatch("[A-Za-z0-9]", out[-1]) and re.fullmatch("[A-Za-z0-9]", line[0]):
                out += " "
            out += line
        return out

    def bare(text, pattern):
        left = re.sub(pattern, "", text, count=1)
        return left if left.strip() else text

    def mark(line):
        return next(((k, m.end()) for k, p in marks.items() if (m := re.match(p, line))), None)

    rows = [dict(r.asDict(), label=r["label"] or ("paragraph" if r["kind"] == "text" else r["kind"])) for r in sorted(rows, key=lambda r: (r["page"], r["ord"]))]
    texts = [r for r in rows if r["kind"] == "text" and r["label"] != "other"]
    left, right = min((r["x0"] for r in texts), default=0), max((r["x1"] for r in texts), default=1)
    sizes = sorted({round(r["size"] * 2) / 2 for r in rows if r["label"] == "heading"}, reverse=True)
    captions, used = {}, set()
    for i, r in enumerate(rows):
        if r["label"] == "caption":
            near = [i - 1, i + 1]
            for j in near[::-1] if re.match(rf"(表|Table){space}*\d", joined(r["text"])) else near:
                if 0 <= j < len(rows) and rows[j]["page"] == r["page"] and rows[j]["label"] in ("table", "figure") and j not in captions:
                    captions[j] = bare(joined(r["text"]), rf"^(?:図|表|Figure|Fig\.|Table){space}*\d+(?:[.\-]\d+)*(?:{space}*[:：.．]{space}*|{space}+)")
                    used.add(i)
                    break
    out, i = [], 0
    while i < len(rows):
        r, label = rows[i], rows[i]["label"]
        if label in ("list", "code"):
            part = []
            while i < len(rows) and rows[i]["label"] == label:
                part.append(rows[i]["text"])
                i += 1
            if label == "code":
                out.append(("code", None, "\n".join(x.rstrip("\n") for x in part), None, None, None, None))
                continue
            kind, items = None, []
            for text in part:
                lines = [x.strip() for x in text.split("\n") if x.strip()]
                some = any(map(mark, lines))
                for k, line in enumerate(lines):
                    if m := mark(line):
                        kind = kind or m[0]
                        items.append(line[m[1] :].strip())
                    elif items and (some or k):
                        items[-1] += "\n" + line
                    else:
                        items.append(line)
            out.append(("list", None, None, kind or "dot", [joined(x) for x in items], None, None))
            continue
        if label == "heading":
            level = r["level"] or min(3, sizes.index(round(r["size"] * 2) / 2) + 1)
            out.append(("heading", level, bare(joined(r["text"]), rf"^\d{{1,2}}(?:\.\d{{1,2}})*(?:\.?{space}+(?![年月日時分秒章節項回位点人個件円倍])|\.(?=[^\d\s]))"), None, None, None, None))
        elif label == "math":
            out.append(("math", None, r["text"].strip(), None, None, None, None))
        elif label == "table":
            out.append(("table", None, None, None, None, captions.get(i), None))
        elif label == "figure":
            out.append(("image", None, None, None, None, captions.get(i), round(min(1.0, max(0.05, (r["x1"] - r["x0"]) / (right - left))), 3) if right > left else 1.0))
        elif (label == "paragraph" or label == "caption" and i not in used) and joined(r["text"]):
            out.append(("paragraph", None, joined(r["text"]), None, None, None, None))
        i += 1
    own = {k: [joined(r["text"]) for r in rows if r["label"] == k] for k in ("title", "author", "date")}
    if any(own.values()):
        out.insert(0, ("title", None, joined("\n".join(own["title"])), None, [" ".join(own["author"]), " ".join(own["date"])], None, None))
    return out


def test_document_blocks_match_a_plain_loop(spark):
    docs = defaultdict(list)
    for r in elements.labelled_elements(Tables(spark, SMALL)).collect():
        docs[r["doc_id"]].append(r)
    want = {(d, k, repr(b)) for d, rows in docs.items() for k, b in enumerate(slow_blocks(rows))}
    got = {(r["doc_id"], r["place"], repr(tuple(r)[2:])) for r in registry.queries()["document_blocks"](spark, SMALL).collect()}
    assert got == want
