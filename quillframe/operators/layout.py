"""Order and shape of pages: weighted modes and medians, reading order, gaps and islands, heading levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: str, ord: str = "ord") -> DataFrame:
    """The value with most weight in each group; of equals the first seen. Aggregated by value first."""
    per = df.groupBy(*by, value).agg(F.sum(weight).alias("w"), F.min(ord).alias("first"))
    return per.groupBy(*by).agg(F.max_by(value, F.struct("w", -F.col("first"))).alias(value))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The smallest value at which twice the weight so far reaches the whole. Runs over distinct values only."""
    per = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    so_far = F.sum("w").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("w").over(Window.partitionBy(*by))
    return per.select(*by, value, (2 * so_far >= whole).alias("reached")).where("reached").groupBy(*by).agg(F.min(value).alias(value))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("all")).select(*by, F.element_at("all", (F.size("all") / 2).cast("int") + 1).alias(value))


def banded_order(df: DataFrame, page: list[str], column: str, top: str, ties: list[str]) -> DataFrame:
    """df with band and place: boxes across both columns cut a page into bands, each read left, then right."""
    so_far = Window.partitionBy(*page).orderBy(top).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn("band", F.sum((F.col(column) == 0).cast("int")).over(so_far))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("band", column, top, *ties)))


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """df with the number of the island each row is in; starts says whether a row begins one (null: yes)."""
    w = Window.partitionBy(*by).orderBy(*order)
    begun = df.withColumn(name, F.coalesce(starts, F.lit(True)).cast("int"))
    return begun.withColumn(name, F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rows_by_gap(df: DataFrame, by: list[str], center: str, size: str) -> DataFrame:
    """Rows of words: a new one begins where the gap to the previous centre is over half the median size."""
    w = Window.partitionBy(*by)
    half = F.percentile(size, F.lit(0.5)).over(w) / 2
    gap = F.col(center) - F.lag(center).over(w.orderBy(center, "ord"))
    d = df.withColumn("_new", F.coalesce(gap > half, F.lit(True)))
    return islands(d, by, [center, "ord"], F.col("_new"), "row").drop("_new")


def runs(df: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """df with the number of its run of equal values."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    d = df.withColumn("_new", changed | F.lag(F.lit(1)).over(w).isNull())
    return islands(d, by, [order], F.col("_new"), "run").drop("_new")


def gap_cuts(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The middles of what no interval covers, by the running maximum of the ends before."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("covered", F.max(end).over(w))
    return d.where(F.col(start) > F.col("covered")).select(*by, ((F.col(start) + F.col("covered")) / 2).alias("cut"))


def heading_ranks(df: DataFrame, by: list[str], size: str, explicit: str) -> DataFrame:
    """df with level: its own, else the rank of its size among the document's, at most 3; 1 without a size."""
    rounded = F.bround(F.col(size) * 2, 0) / 2
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(rounded.desc_nulls_last()))
    return df.withColumn("level_found", F.coalesce(F.col(explicit), F.when(F.col(size).isNull(), 1).otherwise(F.least(F.lit(3), rank))))


def repeated_headers(df: DataFrame, doc: str, page: str, text: str, zone: Column) -> DataFrame:
    """Texts of the top zone on at least two pages of a document."""
    return df.where(zone).groupBy(doc, text).agg(F.countDistinct(page).alias("n_pages")).where("n_pages >= 2")


def two_column_pages(df: DataFrame, page: list[str], column: str, wide: Column) -> DataFrame:
    d = df.where(wide).groupBy(*page).agg(*(F.count_if(F.col(column) == n).alias(name) for n, name in ((1, "left"), (2, "right"), (0, "across"))))
    both = F.col("left") + F.col("right")
    return d.select(*page, "left", "right", "across", ((F.col("left") >= 1) & (F.col("right") >= 1) & (both >= 4) & (F.col("across") * 3 <= both)).alias("two_columns"))


def spans_from_probabilities(df: DataFrame, by: list[str], order: str, p: str, threshold: float) -> DataFrame:
    """(by, start, stop) of the runs of rows with p of at least threshold."""
    d = df.withColumn("_in", F.col(p) >= threshold)
    d = runs(d, by, order, ["_in"]).where("_in")
    return d.groupBy(*by, "run").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop")).drop("run")
