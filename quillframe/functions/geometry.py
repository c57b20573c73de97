"""Boxes as column expressions. A box is four columns or a struct with x0, y0, x1, y1; the origin is at the top left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + n) for n in ("x0", "y0", "x1", "y1")))

    @classmethod
    def field(cls, struct: Column) -> Box:
        return cls(*(struct[n] for n in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero: "not applicable"."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is zero: "worst score"."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def area(b: Box) -> Column:
    return F.greatest(b.width, F.lit(0)) * F.greatest(b.height, F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return ratio_or_zero(both, area(a) + area(b) - both)


def iou_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return ratio_or_zero(F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)), F.greatest(a1, b1) - F.least(a0, b0))


def overlap_ratio(inner: Box, outer: Box) -> Column:
    """The share of inner that outer covers; 0 for an empty inner."""
    return ratio_or_zero(intersection(inner, outer), area(inner))


def overlaps(a: Box, b: Box, margin: float = 0) -> Column:
    return (a.x1 + margin > b.x0) & (b.x1 + margin > a.x0) & (a.y1 + margin > b.y0) & (b.y1 + margin > a.y0)


def contains_point(b: Box, x: Column, y: Column, margin: float = 0) -> Column:
    return x.between(b.x0 - margin, b.x1 + margin) & y.between(b.y0 - margin, b.y1 + margin)


def is_inside(inner: Box, outer: Box, tolerance: float = 2.0) -> Column:
    return (inner.x0 >= outer.x0 - tolerance) & (inner.x1 <= outer.x1 + tolerance) & (inner.y0 >= outer.y0 - tolerance) & (inner.y1 <= outer.y1 + tolerance)


def same_row(a: Box, b: Box) -> Column:
    return (F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)) * 2 > F.least(a.height, b.height)


def near(a: Box, b: Box, gap: float) -> Column:
    return (F.greatest(a.x0, b.x0) - F.least(a.x1, b.x1) <= gap) & (F.greatest(a.y0, b.y0) - F.least(a.y1, b.y1) <= gap)


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates of a group's hull."""
    b = Box.of(prefix)
    return [F.min(b.x0).alias("x0"), F.min(b.y0).alias("y0"), F.max(b.x1).alias("x1"), F.max(b.y1).alias("y1")]


def padded(b: Box, margin: float = 0.004, least_side: float = 0.01) -> Column:
    """The crop box with a margin, within the page; null if a side is too small."""
    fine = (b.width >= least_side) & (b.height >= least_side)
    inner = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(fine, F.struct(inner(b.x0 - margin).alias("x0"), inner(b.y0 - margin).alias("y0"), inner(b.x1 + margin).alias("x1"), inner(b.y1 + margin).alias("y1")))


def normalize(value: Column, size: Column, places: int = 5) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / size)), places)


def denormalize(value: Column, size: Column) -> Column:
    return value * size


def column_of(b: Box, middle: Column, gutter: float = 10.0) -> Column:
    """1 left, 2 right, 0 across; left wins."""
    return F.when(b.x1 <= middle + gutter, 1).when(b.x0 >= middle - gutter, 2).otherwise(0)


def is_light(color: Column, least: float = 0.9) -> Column:
    return F.size(color).isin(1, 3) & F.forall(color, lambda c: c >= least)


def is_vertical(b: Box, times: float = 1.5) -> Column:
    return b.height >= times * b.width


def size_class(height: Column, average: Column) -> Column:
    return F.when(height > 1.5 * average, "large").when(height < 0.7 * average, "small").otherwise("medium")


def polygon_box(points: Column) -> Column:
    """The hull of an array of (x, y) structs."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
