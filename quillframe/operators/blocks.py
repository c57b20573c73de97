"""Labelled elements to the blocks of an editable document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import CAPTION_NUMBER, CONTROLS, HEADING_NUMBER, LOST, MARKERS, TABLE_CAPTION, join_wrapped
from quillframe.operators import characters

MERGED = ("list", "code")
TITLE = ("title", "author", "date")
LEAST_WIDTH = 0.05
#: The patterns of functions/text.py for one text at a time; white space and digits are those of any script here too.
BREAK, WORDS = re.compile(r"\s*\n\s*"), re.compile(r"(?<=[A-Za-z0-9])\n(?=[A-Za-z0-9])")
CONTROL, NUMBERED_CAPTION, NUMBERED_HEADING, TABLE_FIRST = (re.compile(p.removeprefix("(?U)")) for p in (LOST, CAPTION_NUMBER, HEADING_NUMBER, TABLE_CAPTION))
MARKS = {name: re.compile(pattern.removeprefix("(?U)")) for name, pattern in MARKERS.items()}
MENDED = {c: None for c in range(0xA0) if CONTROL.match(chr(c))} | CONTROLS


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(line: str, pattern: re.Pattern) -> str:
    """Without the pattern at its beginning, unless nothing would be left."""
    left = pattern.sub("", line)
    return left if left.strip() else line


def joined(text: str) -> str:
    """join_wrapped of one text."""
    if "\n" not in text:
        return text.strip()
    return WORDS.sub(" ", BREAK.sub("\n", text).strip()).replace("\n", "")


def mended(text: str | None) -> str | None:
    """fix_controls of one text."""
    return text.translate(MENDED) if text and CONTROL.search(text) else text


def list_of(texts: list[str]) -> tuple[str, list[str]]:
    """The mark and the items of consecutive list elements. A marked line begins an item; one without continues the last if its element has marks elsewhere or it is not its first; else it is an item."""
    marker, items = None, []
    for text in texts:
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        marks = [next(((name, p) for name, p in MARKS.items() if p.search(x)), None) for x in lines]
        some = any(marks)
        for k, (line, mark) in enumerate(zip(lines, marks, strict=True)):
            if mark:
                marker = marker or mark[0]
                items.append([mark[1].sub("", line).strip()])
            elif items and (some or k):
                items[-1].append(line)
            else:
                items.append([line])
    return marker or "dot", [joined("\n".join(x)) for x in items]


def taken_captions(rows: list[tuple]) -> dict[int, int]:
    """The captions that go to a table or figure, by their places, with its place: a table's takes the next element first, others the one before, if that is free."""
    target: dict[int, int] = {}
    used: set[int] = set()
    for i, r in enumerate(rows):
        if r[3] == "caption":
            near = (i + 1, i - 1) if TABLE_FIRST.search(r[4]) else (i - 1, i + 1)
            free = [j for j in near if 0 <= j < len(rows) and rows[j][0] == r[0] and rows[j][3] in ("table", "figure") and j not in used]
            if free:
                target[i] = free[0]
                used.add(free[0])
    return target


def blocks_of(rows: list[tuple]) -> list[tuple]:
    """(type, level, text, marker, items, caption, width) of one document's (page, ord, kind, label, text, level, size, x0, x1) in order."""
    sides = [(r[7], r[8]) for r in rows if r[2] == "text" and r[3] is not None and r[3] != "other"]
    left, right = (min((x for x, _ in sides if x is not None), default=None), max((x for _, x in sides if x is not None), default=None))
    half = lambda size: round(size * 2) / 2
    ranks = {x: k for k, x in enumerate(sorted({half(r[6]) for r in rows if r[3] == "heading" and r[6] is not None}, reverse=True), 1)}
    target = taken_captions(rows)
    captions = {j: stripped(joined(rows[i][4]), NUMBERED_CAPTION) for i, j in target.items()}
    out: list[tuple] = []
    own = {name: [joined(r[4]) for r in rows if r[3] == name] for name in TITLE}
    if any(own.values()):
        out.append(("title", None, joined("\n".join(own["title"])), None, [" ".join(own["author"]), " ".join(own["date"])], None, None))
    i = 0
    while i < len(rows):
        _, _, _, label, text, level, size, x0, x1 = rows[i]
        begin, i = i, i + 1
        if label is None or label == "other" or label in TITLE or begin in target:
            continue
        if label in MERGED:
            while i < len(rows) and rows[i][3] == label:
                i += 1
            texts = [r[4] for r in rows[begin:i]]
            if label == "list":
                out.append(("list", None, None, *list_of(texts), None, None))
            else:
                out.append(("code", None, "\n".join(x.rstrip("\n") for x in texts), None, None, None, None))
            continue
        kind, found, shown, width = label, None, None, None
        if label == "heading":
            found = level if level is not None else 1 if size is None else min(3, ranks[half(size)])
            shown = stripped(joined(text), NUMBERED_HEADING)
        elif label == "math":
            shown = text.strip()
        elif label in ("paragraph", "caption"):
            kind, shown = "paragraph", joined(text)
            if not shown:
                continue
        elif label == "figure":
            wide = left is not None and right is not None and right > left
            share = (x1 - x0) / (right - left) if wide and x0 is not None and x1 is not None else 1.0
            kind, width = "image", max(LEAST_WIDTH, min(1.0, share))
        out.append((kind, found, shown, None, None, captions.get(begin), width))
    return out


def to_blocks(df: DataFrame) -> DataFrame:
    """df (doc_id, page, ord, kind, label, text, level, size, x0, x1) -> (doc_id, place, type, level, text, marker, items, caption, width), one row a block.

    Consecutive lists, and consecutive codes, are one block each, across pages
    too. Captions go to the table or figure beside them, or stay paragraphs.
    Titles, authors and dates are one block before all others; what is labelled
    other, and paragraphs without text, are left out. A missing label is that of
    the kind. Wrapped lines are joined but in code; control characters are mended.
    """
    label = F.coalesce(F.col("label"), F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind")))
    row = F.struct("page", "ord", "kind", label.alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.col("level").cast("int").alias("level"), *(F.col(c).cast("double").alias(c) for c in ("size", "x0", "x1")))
    # A document is one row with all its elements: many share an Arrow batch.
    docs = df.groupBy("doc_id").agg(F.collect_list(row).alias("rows"))
    kinds = {"place": pa.int32(), "type": pa.string(), "level": pa.int32(), "text": pa.string(), "marker": pa.string(), "items": pa.list_(pa.string()), "caption": pa.string(), "width": pa.float64()}
    schema = f"doc_id {docs.dtypes[0][1]}, place int, type string, level int, text string, marker string, items array<string>, caption string, width double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, rows in enumerate(characters.rows_of(batch, "rows", ("page", "ord", "kind", "label", "text", "level", "size", "x0", "x1"))):
                rows.sort(key=lambda r: r[:2])
                for place, (kind, level, text, marker, items, caption, width) in enumerate(blocks_of(rows)):
                    at.append(i)
                    made.append((place, kind, level, mended(text), marker, items and [mended(x) for x in items], mended(caption), width))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], names=["doc_id", *kinds])

    return docs.mapInArrow(run, schema).withColumn("width", F.round("width", 3))


def table_block(cells: Column, aligns: Column, col_rules: Column, row_rules: Column, widths: Column, left: Column, right: Column) -> Column:
    """A table's rows, columns and rules: cells' lines joined and rows filled up; what does not fit the number of rows or columns is replaced (left, no upright rules, rules above and below, no widths)."""
    rows = F.when(F.size(cells) > 0, cells).otherwise(F.array(F.array(F.lit(""))))
    fits = lambda xs, size, default: F.when(xs.isNotNull() & (F.size(xs) == size), xs).otherwise(default)
    share = lambda w: F.when(w.isNotNull() & (right > left), F.round(F.least(F.lit(1.0), F.greatest(F.lit(LEAST_WIDTH), w / (right - left))), 3))

    def made(t: Column) -> Column:
        n, n_rows = t["n"], F.size(t["rows"])
        own_rows = fits(row_rules, n_rows + 1, F.transform(F.sequence(F.lit(0), n_rows), lambda i: (i == 0) | (i == n_rows)))
        own_columns = fits(col_rules, n + 1, F.array_repeat(F.lit(False), n + 1))
        own_widths = F.transform(fits(widths, n, F.array_repeat(F.lit(None).cast("double"), n)), share)
        filled = F.transform(t["rows"], lambda r: F.concat(F.transform(r, join_wrapped), F.array_repeat(F.lit(""), n - F.size(r))))
        return F.struct(filled.alias("rows"), fits(aligns, n, F.array_repeat(F.lit("l"), n)).alias("aligns"), own_widths.alias("widths"), own_columns.alias("col_rules"), own_rows.alias("row_rules"))

    # The number of columns is found once a table: within the rows it would be counted over all of them for each one.
    return once(rows, lambda r: once(F.struct(r.alias("rows"), F.greatest(F.array_max(F.transform(r, F.size)), F.lit(1)).alias("n")), made))
