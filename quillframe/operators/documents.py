"""From labelled elements to documents: captions, title blocks, widths, votes, rules and TeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import CAPTION, TABLE_CAPTION, tex_escape


# Fixed value: what a date looks like.
DATE = r"(?U)\d{4}\s*年|\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}|(令和|平成|昭和)\s*(\d+|元)\s*年|(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d"


def attach_captions(df: DataFrame, page: list[str]) -> DataFrame:
    """(page, ord, target) of each caption: a table's takes the next element first, others the one before, if that is a free table or figure; null if neither is."""
    w = Window.partitionBy(*page).orderBy("ord")
    taken = lambda x: F.when(x["label"].isin("table", "figure"), x["ord"])
    here = F.struct("label", "ord")
    first = F.col("text").rlike(TABLE_CAPTION)
    before, after = taken(F.lag(here).over(w)), taken(F.lead(here).over(w))
    c = df.select(*page, "ord", "label", F.when(first, after).otherwise(before).alias("a"), F.when(first, before).otherwise(after).alias("b")).where("label = 'caption'")
    # At most two captions want one target, so the ones already taken are the few of the page.
    zero = F.array().cast("array<struct<ord:bigint,target:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        free = lambda o: o.isNotNull() & ~F.exists(acc, lambda y: F.coalesce(y["target"] == o, F.lit(False)))
        to = F.when(free(x["a"]), x["a"]).when(free(x["b"]), x["b"])
        return F.concat(acc, F.array(F.struct(x["ord"].cast("long").alias("ord"), to.cast("long").alias("target"))))

    g = c.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("ord", "a", "b"))).alias("xs"))
    return g.select(*page, F.explode(F.aggregate("xs", zero, step)).alias("x")).select(*page, "x.ord", "x.target")


def in_order(value: Column, keep: Column, between: str) -> Column:
    """An aggregate: the values of rows that are kept, by ord."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("ord").alias("o"), value.alias("v")))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), between)


def title_blocks(df: DataFrame) -> DataFrame:
    """One row a document: titles joined, authors and dates with spaces between."""
    own = df.where(F.col("label").isin("title", "author", "date"))
    return own.groupBy("doc_id").agg(*(in_order(F.col("text"), F.col("label") == x, "" if x == "title" else " ").alias(x) for x in ("title", "author", "date")))


def image_widths(df: DataFrame) -> DataFrame:
    """A figure's width as a share of the text's, 0.05 to 1."""
    area = df.where("kind = 'text' and label <> 'other'").groupBy("doc_id").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    share = F.try_divide((F.col("x1") - F.col("x0")).cast("double"), (F.col("b") - F.col("a")).cast("double"))
    return df.where("kind = 'figure'").join(area, "doc_id", "left").select("doc_id", "ord", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), share)), 3).alias("width"))


def vote(experts: dict[str, Column], least: float = 0.5, default: str = "paragraph") -> Column:
    """(label, confidence, trace) of the most confident expert, the first of equals; the default label below least."""
    votes = [F.struct(c.cast("double").alias("confidence"), F.lit(-i).alias("place"), F.lit(name).alias("label")) for i, (name, c) in enumerate(experts.items())]
    best = F.array_max(F.array(*votes))
    trace = F.create_map(*(x for name, c in experts.items() for x in (F.lit(name), c.cast("double"))))
    return F.struct(F.when(best["confidence"] < least, default).otherwise(best["label"]).alias("label"), best["confidence"].alias("confidence"), trace.alias("trace"))


def classify(df: DataFrame, size_ratio: float = 1.3, heading_chars: int = 50, caption_chars: int = 100) -> DataFrame:
    """df (kind, text, size2, bold, body) with column rule: a caption, a heading that is large or bold and short, or a paragraph. Texts under tables and figures are taken out first (matching.absorb)."""
    n = F.length("text")
    stands_out = (F.col("size2") >= size_ratio * F.col("body")) | F.coalesce(F.col("bold"), F.lit(False))
    rule = F.when(F.col("kind") != "text", F.col("kind")).when(F.col("text").rlike(CAPTION) & (n <= caption_chars), "caption").when(stands_out & (n <= heading_chars), "heading").otherwise("paragraph")
    return df.withColumn("rule", rule)


def find_titles(df: DataFrame, doc: list[str], width: float, size_ratio: float = 1.3, chars: int = 50, tolerance: float = 0.05, most: float = 0.7, gap: float = 2.0) -> DataFrame:
    """(doc, ord, role) of the title, authors and date on first pages: df has ord, x0, y0, x1, y1, size, text and body.

    From the top, the first run of centred, narrow, short lines that follow one
    another within gap sizes of the largest so far; if its largest size stands
    out from the body, the run from the first line of that size on.
    """
    w = Window.partitionBy(*doc).orderBy("y0", "ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) <= width * tolerance) & (F.col("x1") - F.col("x0") <= width * most) & ~F.col("text").contains("\n") & (F.length("text") <= chars)
    d = df.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    # Before the run nothing fits; what doesn't fit, or is too far down, ends it.
    d = d.withColumn("_begun", F.max(F.col("_fits").cast("int")).over(so_far) == 1).where("_begun")
    d = d.withColumn("_largest", F.max("size").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    far = F.coalesce(F.col("y0") - F.lag("y1").over(w) > gap * F.col("_largest"), F.lit(False))
    d = d.withColumn("_over", F.max((~F.col("_fits") | far).cast("int")).over(so_far) == 1).where("not _over")
    d = d.withColumn("_title", F.max("size").over(Window.partitionBy(*doc))).where(F.col("_title") >= size_ratio * F.col("body"))
    d = d.withColumn("_from", F.max((F.col("size") == F.col("_title")).cast("int")).over(so_far) == 1).where("_from")
    role = F.when(F.col("size") == F.col("_title"), "title").when(F.col("text").rlike(DATE), "date").otherwise("author")
    return d.select(*doc, "ord", role.alias("role"))


def block_tex(label: Column, level: Column, body: Column) -> Column:
    """A block's TeX; body is escaped."""
    command = lambda name: F.concat(F.lit("\\" + name + "{"), body, F.lit("}"))
    heading = F.concat(F.lit("\\"), F.when(level == 1, "").when(level == 2, "sub").otherwise("subsub"), F.lit("section{"), body, F.lit("}"))
    out = F.when(label == "heading", heading).when(label == "list", F.concat(F.lit("\\item "), body)).when(label == "math", F.concat(F.lit("\\["), body, F.lit("\\]"))).when(label == "code", command("texttt"))
    for x in ("title", "author", "date"):
        out = out.when(label == x, command(x))
    return out.otherwise(body)


def to_tex(df: DataFrame) -> DataFrame:
    """doc_id, n_blocks and tex: the documents' blocks by ord, an empty line between; tables, figures and others are left out."""
    kept = df.where(~F.col("label").isin("other", "table", "figure"))
    tex = block_tex(F.col("label"), F.col("level"), tex_escape(F.col("text")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), in_order(tex, F.lit(True), "\n\n").alias("tex"))
