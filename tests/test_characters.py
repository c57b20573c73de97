"""Characters of whole lines against operators on characters as rows, on odd lines and in small parts; and what such queries shuffle."""

from __future__ import annotations

from statistics import median

import pytest
from pyspark.sql import functions as F

from quillframe.operators import characters, composites
from quillframe.plans import composites as plans
from quillframe.plans import registry, shapes
from quillframe.plans.tables import PAGE, Tables

TEXTS = [None, "", "\n", "a", "a b  c\td éあ\U0001f600 e f", "    ", " x" * 40 + "\n\n" + "ab12 " * 30, "あい\n1 2 3 4 5 6 7 8 9 0 12\nz", "\n".join(f"{'ab1 '[k % 4:]} line {k} of  many, ß {k * 7919 % 1000}" for k in range(90))]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    monkeypatch.setattr(characters, "BYTES", 64)


def rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_owners_are_those_of_characters_as_rows(spark, odd):
    t = Tables(spark, odd)
    g = shapes.glyphs(t).withColumn("formula", F.when((F.col("c") != " ") & (F.col("i") % 9 < 6), F.floor(F.col("i") / 9)))
    o = composites.char_owners(g, [*PAGE, "ord"], "i", "c", "formula").where("formula is not null")
    want = o.groupBy(*PAGE, "ord", "formula").agg(F.count("*").alias("n"), F.count_if(F.col("c") == " ").alias("blanks"), F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    got = plans.character_owners(t)
    assert rows(got) == rows(want) and shuffles(got) == 0
    assert registry.queries()["character_owners"](spark, odd).where("blanks > 0").count() > 0


def test_code_is_that_of_characters_as_rows(spark, odd):
    t = Tables(spark, odd)
    got = plans.reindented_code(t)
    assert rows(got) == rows(composites.reindented(plans.code_chars(t), ["doc_id", "block"]))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_medians_of_counted_values(spark):
    values = [[(1.0, 1)], [(2.0, 1), (1.0, 1)], [(3.0, 2), (1.0, 1), (3.0, 1)], [(5.0, 2), (1.0, 2)], []]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, e array<struct<v:double,n:bigint>>")
    assert [r[0] for r in df.orderBy("i").select(characters.weighted_median(F.col("e"))).collect()] == [1.0, 1.5, 3.0, 3.0, None]


def test_elements_are_those_of_characters_as_rows(spark, odd):
    t = Tables(spark, odd)
    i = F.col("i") * 8
    g = shapes.glyphs(t).select(*PAGE, "ord", "i", "c", "baseline", (100 + i).alias("x0"), (107 + i).alias("x1"), (F.col("baseline") - 9).alias("y0"), (F.col("baseline") + 3).alias("y1"))
    r = t.view_of(plans.REGIONS, gt=t.gt).withColumnRenamed("col", "column")
    got = plans.true_elements(t)
    assert rows(got) == rows(composites.true_elements(g, r, PAGE, ["ord", "i"])) and got.count() > 10
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_short_runs_are_not_shuffled(spark, odd):
    got = shapes.short_italic_runs(Tables(spark, odd))
    assert shuffles(got) == 0
    want = {(d, o, i) for d, text in enumerate(TEXTS) for o, line in enumerate((text or "").split("\n")) for i in run_starts([x for x in line if " " <= x <= "~"])}
    assert {(r["doc_id"], r["ord"], r["start"]) for r in got.collect()} == want


def run_starts(cs):
    slanted = [c.isalpha() and i % 7 in (2, 3, 5) for i, c in enumerate(cs)]
    return [i for i, x in enumerate(slanted) if x and not (i and slanted[i - 1])]


def test_baselines_are_not_shuffled(spark, odd):
    got = shapes.line_baselines(Tables(spark, odd))
    assert shuffles(got) == 0
    want = {}
    for d, text in enumerate(TEXTS):
        for o, line in enumerate((text or "").split("\n")):
            # All are nearly as large as the largest: sizes differ by one in twenty.
            if cs := [x for x in line if " " <= x <= "~"]:
                want[d, o] = median(100 + o * 20 + i % 3 for i in range(len(cs)))
    assert {(r["doc_id"], r["ord"]): r["baseline"] for r in got.collect()} == want


def test_glyphs_are_counted_before_they_meet_regions(spark, odd):
    plan = shapes.region_glyphs(Tables(spark, odd))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]
