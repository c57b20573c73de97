"""Recognised words and polygons to text elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.geometry import normalize
from quillframe.functions.text import join_words, strip


def word_elements(words: DataFrame, page: list[str], width: Column, height: Column, scale: float = 1.0, least: float = 0.0) -> DataFrame:
    """Words (page, ord, block, par, line, text, conf, left, top, width, height) -> one text element for each paragraph (page, block, par).

    Blank words and those recognised with less than least are dropped. Boxes are
    divided by scale and given as shares of the page; font_size is the upper
    median of the lines' heights, confidence the mean of the words'. Lines and
    words keep the order in which they were recognised.
    """
    w = words.where((strip(F.col("text")) != "") & (F.col("conf") >= least))
    box = [F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1")]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("text")))), lambda x: x["text"])
    lines = w.groupBy(*page, "block", "par", "line").agg(*box, F.min("ord").alias("ord"), join_words(ordered).alias("text"), F.sum("conf").alias("conf"), F.count("*").alias("n"))
    heights = F.array_sort(F.collect_list((F.col("y1") - F.col("y0")) / scale))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    p = lines.groupBy(*page, "block", "par").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("ord").alias("ord"), F.array_join(texts, "\n").alias("text"), F.element_at(heights, F.floor(F.count("*") / 2).cast("int") + 1).alias("font_size"), (F.sum("conf") / F.sum("n") / 100).alias("confidence"))
    p = p.where("x1 > x0 and y1 > y0")
    shares = [normalize(F.col(c) / scale, size).alias(c) for c, size in (("x0", width), ("y0", height), ("x1", width), ("y1", height))]
    # Rounded as a number of ten-thousandths, as SQL engines do it: the mean itself is rounded by its decimal digits, which decides ties otherwise.
    confidence = F.round(F.col("confidence") * 10000, 0) / 10000
    return p.select(*page, "ord", *shares, "text", F.round("font_size", 1).alias("font_size"), confidence.alias("confidence"))


def text_in_boxes(boxes: DataFrame, texts: DataFrame, page: list[str]) -> DataFrame:
    """(page, ord, text) of all boxes (ord, x0, y0, x1, y1): the texts (ord, x0 ... y1, text) whose centres they hold, borders included, in order, a line each; null without any."""
    t = texts.select(*page, F.col("ord").alias("o"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "text")
    inside = boxes.join(t, page).where("cx between x0 and x1 and cy between y0 and y1")
    joined = inside.groupBy(*page, "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return boxes.select(*page, "ord").join(joined, [*page, "ord"], "left")
