"""Checks of documents, elements, runs and tables: arrays of messages, empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import LABELS

VERSION = 4


def messages(checks: dict[str, Column]) -> Column:
    """The messages whose conditions hold; a null condition doesn't."""
    return F.filter(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())), lambda m: m.isNotNull())


def element_problems() -> Column:
    c = F.col
    return messages(
        {
            "kind is unknown": ~c("kind").isin("text", "table", "figure"),
            "box is empty or inverted": (c("x0") >= c("x1")) | (c("y0") >= c("y1")),
            "text is missing": (c("kind") == "text") & c("text").isNull(),
            "label is unknown": ~c("label").isin(*LABELS),
            "level without a heading": c("level").isNotNull() & ~c("label").eqNullSafe(F.lit("heading")),
            "level is out of range": (c("label") == "heading") & ~c("level").between(1, 3),
        }
    )


def share_problems(box: Column) -> Column:
    """Of a box given as shares of the page: another number than four, and values beyond the page."""
    return messages({"box has not four numbers": F.size(box) != 4, "box is beyond the page": (F.size(box) == 4) & F.exists(box, lambda v: (v < 0) | (v > 1))})


def run_problems(text: Column, runs: Column) -> Column:
    """runs: array of (text, bold, italic, underline, tex) structs."""
    return messages(
        {
            "a run is empty": F.exists(runs, lambda r: F.coalesce(r["text"], F.lit("")) == ""),
            "a run's TeX is blank": F.exists(runs, lambda r: r["tex"].isNotNull() & (F.trim(r["tex"]) == "")),
            "runs differ from the text": F.array_join(F.transform(runs, lambda r: r["text"]), "") != text,
        }
    )


def table_problems(cells: Column, aligns: Column, col_rules: Column, row_rules: Column, widths: Column) -> Column:
    """cells: array of rows; the others may be null."""
    columns = F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))
    return messages(
        {
            "alignments don't fit the columns": F.size(aligns) != columns,
            "an alignment is unknown": F.exists(aligns, lambda a: ~a.isin("l", "c", "r")),
            "column rules don't fit the columns": F.size(col_rules) != columns + 1,
            "row rules don't fit the rows": F.size(row_rules) != F.size(cells) + 1,
            "widths don't fit the columns": F.size(widths) != columns,
            "a width is out of range": F.exists(widths, lambda w: (w <= 0) | (w > 1)),
        }
    )


def document_problems(version: Column, pages: Column) -> Column:
    """pages: array of (page, width, height, unit) structs."""
    return messages(
        {
            "version is unknown": ~version.isin(1, 2, 3, VERSION),
            "pages are not numbered from 1": F.transform(pages, lambda p: p["page"].cast("int")) != F.transform(pages, lambda p, i: i + 1),
            "a page has no size": F.exists(pages, lambda p: (p["width"] <= 0) | (p["height"] <= 0)),
            "a unit is unknown": F.exists(pages, lambda p: ~p["unit"].isin("pt", "px")),
        }
    )
