"""Grouping whose steps depend on the groups so far: one function call a page, many pages an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def near(a: tuple, b: tuple, gap: float) -> bool:
    return max(a[0], b[0]) - min(a[2], b[2]) <= gap and max(a[1], b[1]) - min(a[3], b[3]) <= gap


def hull(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def closure(boxes: list[tuple], gap: float) -> list[int]:
    """For each box the first one that it can reach over near boxes."""
    root = list(range(len(boxes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(boxes)):
        for j in range(i):
            if near(boxes[i], boxes[j], gap):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(boxes))]


def merged(boxes: list[tuple], gap: float) -> list[tuple]:
    """Hulls, each joined to the first one near it, until none are near."""
    out: list[tuple] = []
    for box in boxes:
        at = 0
        while at < len(out):
            if near(out[at], box, gap):
                box, at = hull(out.pop(at), box), 0
            else:
                at += 1
        out.append(box)
    return sorted(out)


def blocks(rows: list[tuple], gap: float = 0.8, ratio: float = 1.3, indent: float = 0.8, short: float = 2.0) -> list[int]:
    """A block's number for each (x0, y0, x1, y1) line, from the top: of the blocks so far, the latest whose last line it continues.

    Measures are in heights of the taller of the two lines: the gap between
    them, how far the line is indented against its block (a new paragraph), and
    how much shorter than it the last line is (a paragraph that ended).
    """
    open_blocks: list[tuple[tuple, float]] = []  # the last line and the left edge
    out = []
    for box in rows:
        found = len(open_blocks)
        for k in range(len(open_blocks) - 1, -1, -1):
            last, left = open_blocks[k]
            heights = box[3] - box[1], last[3] - last[1]
            unit = max(heights)
            near_enough = box[1] - last[3] <= unit * gap and unit <= ratio * min(heights)
            beside = min(last[2], box[2]) > max(last[0], box[0])
            if near_enough and beside and box[0] - left < unit * indent and box[2] - last[2] < unit * short:
                found = k
                break
        if found == len(open_blocks):
            open_blocks.append((box, box[0]))
        else:
            open_blocks[found] = box, min(open_blocks[found][1], box[0])
        out.append(found)
    return out


def by_page(df: DataFrame, page: list[str], make: Callable[[list, list[tuple]], tuple], more: dict[str, str]) -> DataFrame:
    """make's columns (more: their types) for each page's ords and boxes; a page is one row, and many share an Arrow batch."""
    field = lambda c: F.transform("e", lambda x: x[c]).alias(c)
    rows = df.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("ord", *BOX))).alias("e")).select(*page, *(field(c) for c in ("ord", *BOX)))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in page), *(f"`{c}` {kind}" for c, kind in more.items())])
    kinds = [pa.float64() if kind == "double" else pa.int64() for kind in more.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, made = [], [[] for _ in kinds]
            for ords, *sides in zip(*(batch.column(c).to_pylist() for c in ("ord", *BOX)), strict=True):
                out = make(ords, list(zip(*sides, strict=True)))
                counts.append(len(out[0]))
                for whole, part in zip(made, out, strict=True):
                    whole.extend(part)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in page), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=[*page, *more])

    return rows.mapInArrow(run, schema)


def near_components(df: DataFrame, page: list[str], gap: float) -> DataFrame:
    """(page, ord, fragment): the smallest ord among the boxes that near ones connect."""
    return by_page(df, page, lambda ords, boxes: (ords, [ords[i] for i in closure(boxes, gap)]), {"ord": "long", "fragment": "long"})


def merge_boxes(df: DataFrame, page: list[str], gap: float) -> DataFrame:
    """(page, box): hulls of boxes that are near or become so."""
    return by_page(df, page, lambda _, boxes: tuple(zip(*merged(boxes, gap), strict=True)), dict.fromkeys(BOX, "double"))


def line_blocks(df: DataFrame, page: list[str]) -> DataFrame:
    """(page, ord, block) of all lines."""
    return by_page(df, page, lambda ords, boxes: (ords, blocks(boxes)), {"ord": "long", "block": "long"}).withColumn("block", F.col("block") + 1)
