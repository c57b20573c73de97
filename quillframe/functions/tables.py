"""Comparisons of tables' cells, alignments, rules and widths, place by place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_places(gt: Column, pred: Column) -> Column:
    """How many places of gt have the same value in pred; what pred lacks is different."""
    n = F.least(F.size(gt), F.greatest(F.size(pred), F.lit(0)))
    same = F.zip_with(F.slice(gt, F.lit(1), n), F.slice(pred, F.lit(1), n), lambda a, b: a.eqNullSafe(b))
    return F.when(pred.isNull(), 0).otherwise(F.size(F.filter(same, lambda x: x)))


def widths_right(gt: Column, pred: Column, tolerance: float) -> tuple[Column, Column]:
    """Columns where either has a width, and those of them where both have and differ by at most tolerance."""
    both = F.zip_with(gt, pred, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    stated = F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull())
    return F.size(stated), F.size(F.filter(stated, lambda x: F.coalesce(F.abs(x["a"] - x["b"]) <= tolerance, F.lit(False))))
