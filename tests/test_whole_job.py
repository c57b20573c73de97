"""Queries against plain loops over all their rows."""

from __future__ import annotations

from collections import Counter, defaultdict

from quillframe.plans import layouts, registry
from quillframe.plans.tables import Tables

SMALL = "/root/testdata/sf0.001"
BOX = ("x0", "y0", "x1", "y1")


def pages(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"], r["page"]].append(r)
    return out


def apart(a, b, gap):
    return max(a[0], b[0]) - min(a[2], b[2]) > gap or max(a[1], b[1]) - min(a[3], b[3]) > gap


def test_figure_clusters_merge_all_elements(spark):
    elements = layouts.scattered(Tables(spark, SMALL)).collect()
    assert len(elements) == Tables(spark, SMALL).lines.count()
    expected, sizes = Counter(), Counter()
    for page, rows in pages(elements).items():
        groups = [(tuple(r[c] for c in BOX), 1) for r in rows]
        while near := next(((i, j) for i in range(len(groups)) for j in range(i) if not apart(groups[i][0], groups[j][0], 30)), None):
            (a, n), (b, k) = (groups[i] for i in near)
            groups = [g for i, g in enumerate(groups) if i not in near] + [((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), n + k)]
        expected.update((*page, *box) for box, _ in groups)
        sizes.update(n for _, n in groups)
    found = Counter(tuple(r) for r in registry.queries()["figure_clusters"](spark, SMALL).select("doc_id", "page", *BOX).collect())
    assert found == expected
    assert set(sizes) >= {1, 2, 3, 4, 5}


def test_fragment_components_have_a_row_for_every_text_line(spark):
    lines = Tables(spark, SMALL).gt.where("kind = 'text'").collect()
    expected, sizes = {}, Counter()
    for page, rows in pages(lines).items():
        left = {r["ord"]: tuple(r[c] for c in BOX) for r in rows}
        while left:
            first = min(left)
            reached, todo = {}, [first]
            while todo:
                i = todo.pop()
                reached[i] = left.pop(i)
                todo += [j for j in left if j not in todo and not apart(reached[i], left[j], 4)]
            sizes[len(reached)] += 1
            expected |= {(*page, i): first for i in reached}
    found = {(r["doc_id"], r["page"], r["ord"]): r["fragment"] for r in registry.queries()["fragment_components"](spark, SMALL).collect()}
    assert found == expected
    assert max(sizes) > 2


def test_repeated_headers_compare_whole_texts(spark):
    on = defaultdict(set)
    for r in Tables(spark, "/root/testdata/sf0.01").gt.where("ord % 40 < 6").collect():
        on[r["doc_id"], r["text"]].add(r["page"])
    expected = {(*k, len(v)) for k, v in on.items() if len(v) >= 2}
    found = registry.queries()["repeated_headers"](spark, "/root/testdata/sf0.01").collect()
    assert {(r["doc_id"], r["header"], r["n_pages"]) for r in found} == expected
    assert len(found) == len(expected) > 0


def test_standardise_features_scales_every_component(spark, tmp_path):
    import numpy as np

    given = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    flat = given.selectExpr("vec_id", "label", "transform(embedding, (x, i) -> if(i = 3, cast(0.25 as float), x)) as embedding")
    flat.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = flat.collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    train = x[[r["vec_id"] % 5 != 0 for r in rows]]
    std = train.std(axis=0)
    assert std[3] < 1e-6
    expected = dict(zip([r["vec_id"] for r in rows], (x - train.mean(axis=0)) / np.where(std < 1e-6, 1, std), strict=True))
    found = registry.queries()["standardise_features"](spark, str(tmp_path)).collect()
    assert len(found) == len(expected) == len(rows)
    for r in found:
        assert len(r["features"]) == 64 and np.allclose(r["features"], expected[r["vec_id"]], atol=2e-6)


def test_row_islands_number_all_elements_and_merge_some(spark):
    from statistics import median

    expected, sizes = {}, Counter()
    for page, rows in pages(layouts.in_rows(Tables(spark, SMALL)).collect()).items():
        half, row, before, filled = median(r["size"] for r in rows) / 2, 0, None, Counter()
        for center, i in sorted((r["center"], r["ord"]) for r in rows):
            row += before is None or center - before > half
            before = center
            filled[row] += 1
            expected[(*page, i)] = row
        sizes.update(filled.values())
    found = {(r["doc_id"], r["page"], r["ord"]): r["row"] for r in registry.queries()["row_islands_by_gap"](spark, SMALL).collect()}
    assert found == expected and len(found) == Tables(spark, SMALL).lines.count()
    assert set(sizes) >= {1, 2, 3}


def test_gap_cuts_see_all_elements_as_cover(spark):
    elements = layouts.overlapping(Tables(spark, SMALL)).collect()
    assert len(elements) == Tables(spark, SMALL).lines.count()
    expected, covered = Counter(), 0
    for page, rows in pages(elements).items():
        rows.sort(key=lambda r: (r["y0"], r["y1"]))
        end = rows[0]["y1"]
        for r in rows[1:]:
            expected[(*page, (r["y0"] + end) / 2)] += r["y0"] > end
            covered += r["y0"] <= end
            end = max(end, r["y1"])
    assert Counter(tuple(r) for r in registry.queries()["interval_gap_cuts"](spark, SMALL).select("doc_id", "page", "cut").collect()) == +expected
    assert covered and +expected


def test_tex_token_scope_asks_for_length_and_vocabulary(spark, tmp_path):
    import re

    rows = [(1, r"\alpha + x"), (2, "x " * 50), (3, "x " * 51), (5, r"\alpha x"), (10, r"\beta x"), (15, None), (15, "y"), (20, "x" * 200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = [(i, re.findall(r"\\[a-zA-Z]+|\\.|\S", t or "")) for i, t in rows]
    known = {x for i, ts in tokens if i % 5 for x in ts}
    expected = Counter((i, len(ts), len(ts) <= 50 and known.issuperset(ts)) for i, ts in tokens)
    found = Counter(tuple(r) for r in registry.queries()["tex_token_scope"](spark, str(tmp_path)).select("doc_id", "n_tokens", "in_scope").collect())
    assert found == expected and {k[2] for k in found} == {True, False}
