"""Joins of boxes: greedy one-to-one matching, argmax and nearest joins, absorption. All are joins on a page key plus a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.geometry import Box, area, contains_point, iou, overlap_ratio
from quillframe.functions.text import CAPTION


def pairs(pred: DataFrame, gt: DataFrame, page: list[str], condition: Column) -> DataFrame:
    return pred.join(gt, page).where(condition)


def renamed(df: DataFrame, page: list[str], prefix: str) -> DataFrame:
    return df.select(*page, *(F.col(c).alias(prefix + c) for c in df.columns if c not in page))


def candidate_pairs(pred: DataFrame, gt: DataFrame, page: list[str], threshold: float = 0.5) -> DataFrame:
    """p_ and g_ columns of all pairs of a page with iou of at least threshold."""
    both = renamed(pred, page, "p_").join(renamed(gt, page, "g_"), page)
    return both.withColumn("iou", iou(Box.of("p_"), Box.of("g_"))).where(F.col("iou") >= threshold)


def greedy(candidates: Column) -> Column:
    """Of (iou, i, j) structs, those taken one by one from the highest (iou, i, j) whose i and j are both free."""
    empty = F.filter(candidates, lambda c: F.lit(False))
    zero = F.struct(empty.alias("taken"))

    def step(acc: Column, c: Column) -> Column:
        free = ~F.exists(acc["taken"], lambda t: (t["i"] == c["i"]) | (t["j"] == c["j"]))
        return F.struct(F.when(free, F.concat(acc["taken"], F.array(c))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(F.reverse(F.array_sort(candidates)), zero, step, lambda acc: acc["taken"])


def matched_pages(pred: DataFrame, gt: DataFrame, page: list[str], columns: list[str], threshold: float = 0.5) -> DataFrame:
    """(page, gs, ps, pairs): a page's true and predicted elements (ord, box and columns) by ord, and the pairs (iou, i, j, g, p) taken, of all pages that either side has.

    Both sides meet in one shuffle by page, where all that is to be known of
    them is at hand. A page's boxes are compared with each other only where
    their rows overlap.
    """
    fields = ["ord", "x0", "y0", "x1", "y1", *columns]
    sides = [df.select(*page, F.lit(side).alias("side"), F.struct(*(F.col(c).alias(c) for c in fields)).alias("e")) for df, side in ((gt, "g"), (pred, "p"))]
    whole = sides[0].unionByName(sides[1]).groupBy(*page).agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == x, F.col("e")))).alias(f"{x}s") for x in "gp"))

    def candidates(p: Column) -> Column:
        beside = F.filter(F.col("gs"), lambda g: (F.least(g["y1"], p["y1"]) > F.greatest(g["y0"], p["y0"])) & (F.least(g["x1"], p["x1"]) > F.greatest(g["x0"], p["x0"])))
        scored = F.transform(beside, lambda g: F.struct(iou(Box.field(p), Box.field(g)).alias("iou"), p["ord"].alias("i"), g["ord"].alias("j"), g.alias("g"), p.alias("p")))
        return F.filter(scored, lambda c: c["iou"] >= threshold)

    return whole.withColumn("pairs", F.flatten(F.transform("ps", candidates))).withColumn("pairs", greedy(F.col("pairs")))


def match(pred: DataFrame, gt: DataFrame, page: list[str], threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs (page, i, j, iou) of the boxes' column ord."""
    taken = matched_pages(pred, gt, page, [], threshold)
    return taken.select(*page, F.explode("pairs").alias("t")).select(*page, "t.i", "t.j", "t.iou")


def best_overlap(inner: DataFrame, outer: DataFrame, page: list[str], value: str, least: float = 0.5) -> DataFrame:
    """Each inner box with the value of the outer box that covers most of it, the first of equals; null below least."""
    both = renamed(inner, page, "p_").join(renamed(outer, page, "g_"), page)
    both = both.withColumn("ratio", overlap_ratio(Box.of("p_"), Box.of("g_"))).where(F.col("ratio") >= least)
    best = both.groupBy(*page, F.col("p_ord").alias("ord")).agg(F.max_by(f"g_{value}", F.struct("ratio", -F.col("g_ord"))).alias(value))
    return inner.select(*page, "ord").join(best, [*page, "ord"], "left")


def smallest_container(points: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Each point (ord, x, y) with the ord of the smallest box around it, the first of equals; null if there is none."""
    both = renamed(points, page, "p_").join(renamed(boxes, page, "g_"), page).where(contains_point(Box.of("g_"), F.col("p_x"), F.col("p_y")))
    best = both.groupBy(*page, F.col("p_ord").alias("ord")).agg(F.min_by("g_ord", F.struct(area(Box.of("g_")).alias("a"), F.col("g_ord").alias("o"))).alias("container"))
    return points.select(*page, "ord").join(best, [*page, "ord"], "left")


def nearest_interval(points: DataFrame, intervals: DataFrame, page: list[str], above: float, below: float, most: float) -> DataFrame:
    """Each point (ord, y) with the ord of the nearest interval (ord, top, bottom), stretched by above and below; null at most or farther."""
    both = renamed(points, page, "p_").join(renamed(intervals, page, "g_"), page)
    top, bottom = F.col("g_top") - above, F.col("g_bottom") + below
    both = both.withColumn("distance", F.greatest(F.lit(0), top - F.col("p_y"), F.col("p_y") - bottom)).where(F.col("distance") < most)
    best = both.groupBy(*page, F.col("p_ord").alias("ord")).agg(F.min_by("g_ord", F.struct("distance", (bottom - top).alias("h"), F.col("g_ord").alias("o"))).alias("interval"))
    return points.select(*page, "ord").join(best, [*page, "ord"], "left")


def absorb(texts: DataFrame, regions: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """texts without those that a region covers by at least least."""
    r = renamed(regions, page, "g_")
    same = [texts[c] == r[c] for c in page]
    own = Box(*(texts[n] for n in ("x0", "y0", "x1", "y1")))
    other = Box(*(r[f"g_{n}"] for n in ("x0", "y0", "x1", "y1")))
    condition = overlap_ratio(own, other) >= least
    for s in same:
        condition = condition & s
    return texts.join(r, condition, "left_anti")


def captions_by_gap(targets: DataFrame, texts: DataFrame, page: list[str], body: float, chars: int = 150) -> DataFrame:
    """(page, ord, caption) of tables and figures (ord, box): in order, each takes the free caption beside it in x whose vertical gap, from -2 to less than four body sizes, is smallest, the first of equals; those without one are left out."""
    c = texts.where(F.col("text").rlike(CAPTION) & (F.length("text") <= chars))
    both = renamed(targets, page, "g_").join(renamed(c, page, "p_"), page)
    gap = F.greatest(F.col("p_y0") - F.col("g_y1"), F.col("g_y0") - F.col("p_y1"))
    both = both.withColumn("gap", gap).where((F.col("gap") >= -2) & (F.col("gap") < 4 * body) & (F.least("g_x1", "p_x1") > F.greatest("g_x0", "p_x0")))
    rows = both.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("g_ord").alias("o"), "gap", F.col("p_ord").alias("c")))).alias("xs"))
    empty = F.array().cast("array<struct<o:bigint,c:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: (y["o"] == x["o"]) | (y["c"] == x["c"]))
        return F.when(free, F.concat(acc, F.array(F.struct(x["o"].cast("bigint").alias("o"), x["c"].cast("bigint").alias("c"))))).otherwise(acc)

    return rows.select(*page, F.explode(F.aggregate("xs", empty, step)).alias("x")).select(*page, F.col("x.o").alias("ord"), F.col("x.c").alias("caption"))
