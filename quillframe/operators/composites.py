"""Operators made of several others: rule labels with page context, training sets, sources with their inputs, paragraphs of lines, a page's character errors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.geometry import Box, overlap_ratio
from quillframe.functions.text import distance, strip
from quillframe.operators import characters, layout
from quillframe.operators.matching import renamed

# The patterns and limits by which blocks are told apart must be these for the same labels.
PAGE_NUMBER = r"(?iU)^[-–—\s]*(?:\d+|[ivxlc]+)[-–—\s]*$"
SECTION_NUMBER = r"(?U)^(\d+(?:\.\d+)*)\.?\s"
TOP, HEADER_ZONE, BOTTOM = 0.07, 0.15, 0.105
INPUT = re.compile(r"\\input\{([^}]*)\}")
LARGE, FIRST_LEVEL, SECOND_LEVEL = 1.15, 1.32, 1.1


def hybrid_labels(df: DataFrame, width: float, height: float) -> DataFrame:
    """df with label and level, by rules that know the document's body size and font and its running headers.

    df has doc_id, page, ord (document-wide), kind, text, n_rows, font, size,
    bold, mono_ratio, math_ratio, list_head and a box; caption tells whether a
    table or figure took the block, role its part in the title. Body size and
    font are those with most characters. A heading's level is its number's
    depth, else by its size against that of paragraphs and lists.
    """
    d = df.withColumn("shown", strip(F.coalesce("text", F.lit("")))).withColumn("chars", F.length("shown"))
    texts = d.where("kind = 'text'")
    body = layout.weighted_mode(texts.where("size is not null"), ["doc_id"], "size", "chars").select("doc_id", F.col("size").alias("body_size"))
    font = layout.weighted_mode(texts.where("font <> ''"), ["doc_id"], "font", "chars").select("doc_id", F.col("font").alias("body_font"))
    headers = layout.repeated_headers(texts, "doc_id", "page", "shown", (F.col("n_rows") == 1) & (F.col("y1") <= height * HEADER_ZONE)).select("doc_id", "shown", F.lit(True).alias("header"))
    d = d.join(body, "doc_id", "left").join(font, "doc_id", "left").join(headers, ["doc_id", "shown"], "left")
    large = F.col("size") >= F.coalesce("body_size", F.lit(10.0)) * LARGE
    numbered = F.col("shown").rlike(SECTION_NUMBER)
    other_font = ~F.col("font").eqNullSafe(F.coalesce("body_font", F.lit("")))
    bottom = F.when(F.col("y0") >= height * (1 - BOTTOM), F.col("shown").rlike(PAGE_NUMBER) | (F.col("chars") <= 20))
    top = F.when(F.col("y1") <= height * TOP, True).when(F.col("y1") <= height * HEADER_ZONE, F.col("header").isNotNull() | (F.col("x0") >= width / 2))
    edge = (F.col("n_rows") <= 1) & (F.col("chars") <= 60) & F.coalesce(bottom, top, F.lit(False))
    heading = (F.col("chars") <= 80) & (F.col("n_rows") <= 2) & (F.coalesce(large, F.lit(False)) | ((F.col("n_rows") == 1) & numbered & (F.coalesce("bold", F.lit(False)) | other_font)))
    label = F.when(F.col("kind") != "text", F.col("kind")).when(F.col("caption"), "caption").when(F.col("role").isNotNull(), F.col("role")).when(edge, "other").when(F.col("mono_ratio") >= 0.6, "code").when(F.col("math_ratio") >= 0.3, "math")
    d = d.withColumn("label", label.when(F.col("list_head"), "list").when(heading, "heading").otherwise("paragraph"))
    prose = layout.weighted_mode(d.where("label in ('paragraph', 'list') and size > 0"), ["doc_id"], "size", "chars").select("doc_id", F.col("size").alias("prose_size"))
    d = d.join(prose, "doc_id", "left")
    usual = F.coalesce("prose_size", F.lit(10.0))
    share = F.coalesce("size", usual) / usual
    depth = F.least(F.lit(3), F.size(F.split(F.regexp_extract("shown", SECTION_NUMBER, 1), r"\.")))
    level = F.when(F.col("label") == "heading", F.when(numbered, depth).when(share >= FIRST_LEVEL, 1).when(share >= SECOND_LEVEL, 2).otherwise(3))
    return d.withColumn("level", level).select(*(c for c in df.columns if c not in ("label", "level")), "label", "level")


def block_training_rows(found: DataFrame, truth: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """Each found block (ord, box, label by rule) with the label, level and share of the true element that covers most of it, nulls below least; same tells whether it goes on what the block before it belongs to, null if either belongs to none."""
    both = renamed(found, page, "p_").join(renamed(truth, page, "g_"), page)
    both = both.withColumn("overlap", overlap_ratio(Box.of("p_"), Box.of("g_"))).where("overlap > 0")
    best = both.groupBy(*page, F.col("p_ord").alias("ord")).agg(F.max_by(F.struct("overlap", "g_ord", "g_label", "g_level"), F.struct("overlap", -F.col("g_ord"))).alias("e"))
    owned = F.when(F.col("e.overlap") >= least, F.col("e"))
    d = found.select(*page, "ord", F.col("label").alias("rule_label")).join(best, [*page, "ord"], "left").withColumn("own", owned)
    before = F.lag("own.g_ord").over(Window.partitionBy(*page).orderBy("ord"))
    return d.select(*page, "ord", "rule_label", F.col("own.g_label").alias("label"), F.col("own.g_level").alias("level"), F.coalesce("e.overlap", F.lit(0.0)).alias("overlap"), (before == F.col("own.g_ord")).alias("same"))


def char_owners(chars: DataFrame, by: list[str], order: str, char: str, owner: str) -> DataFrame:
    """chars with owner as it is for visible characters; a blank one gets its neighbours' if the nearest visible ones before and after agree."""
    visible = F.col(char).isNotNull() & ~F.col(char).rlike(r"(?U)^\s*$")
    seen = F.when(visible, F.struct(F.col(owner).alias("id")))
    # Both look back, one from the end: a frame that looks ahead would be gone through anew for each row.
    before, after = (F.last(seen, ignorenulls=True).over(Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1))["id"] for o in (F.col(order), F.col(order).desc()))
    return chars.withColumn(owner, F.when(visible, F.col(owner)).when(before == after, before))


def inline_inputs(mains: DataFrame, files: DataFrame, by: list[str], deepest: int = 20) -> DataFrame:
    r"""mains (by, text) with each \input{name} replaced by the text of by's file (name, text), whose own inputs are replaced too; ".tex" may be left out.

    Inputs of no file are an error when texts are read, those nested deeper
    than deepest at once. Of files of one name the first by name and text counts.
    """
    sides = [F.lit(None).cast("string").alias("main"), F.struct("name", "text").alias("file")], [F.col("text").alias("main"), F.lit(None).cast("struct<name:string,text:string>").alias("file")]
    every = files.where("text is not null").select(*by, *sides[0]).unionByName(mains.select(*by, *sides[1]))
    return inlined(every.groupBy(*by).agg(F.collect_list("main").alias("mains"), F.collect_list("file").alias("files")), by, deepest)


def inlined(groups: DataFrame, by: list[str], deepest: int = 20) -> DataFrame:
    """inline_inputs of texts (mains) that are one row with all their files (name, text); many share an Arrow batch."""
    keys = groups.select(*by)

    def run(keep: list[str], make: Callable[[str, dict[str, list[str]]], str | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, texts = [], []
                for i, (mains, files) in enumerate(zip(batch.column("mains"), characters.rows_of(batch, "files", ("name", "text")), strict=True)):
                    parts = {suffixed(name): cut_up(text) for name, text in sorted(files, reverse=True)}
                    for text in mains.as_py():
                        made = make(text, parts)
                        if made is not None:
                            at.append(i)
                            texts.append(made)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

        return of_batches

    def too_deep(text: str, parts: dict[str, list[str]]) -> str | None:
        # Names alone; what is no file is found when texts are read.
        bare = {name: ["" if i % 2 == 0 else x for i, x in enumerate(pieces)] for name, pieces in parts.items()}
        try:
            put_in_place(text, bare, deepest, missing=[""])
        except RecursionError:
            return ""
        return None

    if not groups.mapInArrow(run([], too_deep), "text string").isEmpty():
        raise ValueError(f"inputs are nested deeper than {deepest}")
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in keys.dtypes), "text string"])
    return groups.mapInArrow(run(by, lambda text, parts: put_in_place(text, parts, deepest)), schema)


def suffixed(name: str) -> str:
    """The name of a source with ".tex" for any other ending."""
    return name if re.search(r"[^/]\.tex\Z", name) else re.sub(r"(?<=[^/])\.[^./]+\Z", "", name) + ".tex"


def cut_up(text: str) -> list[str]:
    """A text cut at its inputs: every second piece is the name of one."""
    pieces = INPUT.split(text)
    pieces[1::2] = map(suffixed, pieces[1::2])
    return pieces


def put_in_place(text: str, parts: dict[str, list[str]], deepest: int, missing: list[str] | None = None) -> str:
    """A text with the files' pieces at its inputs, each file put together once; missing stands for what is no file."""
    known: dict[str, tuple[str, int]] = {}

    def whole(pieces: list[str], level: int) -> tuple[str, int]:
        if level > deepest:
            raise RecursionError(f"inputs are nested deeper than {deepest}")
        out, height = list(pieces), 0
        for i in range(1, len(pieces), 2):
            name = pieces[i]
            if name not in known:
                own = parts.get(name, missing)
                if own is None:
                    raise LookupError(f"no file {name}")
                known[name] = whole(own, level + 1)
            out[i] = known[name][0]
            height = max(height, known[name][1] + 1)
        if level + height > deepest:
            raise RecursionError(f"inputs are nested deeper than {deepest}")
        return "".join(out), height

    return whole(cut_up(text), 0)[0]


LINE = "struct<ord:bigint,label:string,x0:double,y0:double,x1:double,y1:double,size:double,text:string>"


def paragraphs_of_lines(df: DataFrame, page: list[str]) -> DataFrame:
    """(page, ord, label, box, text) of lines (ord, label, box, size, text) in reading order, where a paragraph's or list's line goes on what is before it.

    It does if it has the same label, begins less than three sizes beside it
    and from half a size above to 0.8 sizes below its end, and, in paragraphs,
    is not indented by over half a size and what is before does not end over
    two sizes earlier. What lines were joined is compared as a whole.
    """
    numbers = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    line = F.struct(F.col("ord").cast("bigint").alias("ord"), "label", *numbers, F.coalesce(F.col("size").cast("double"), F.lit(10.0)).alias("size"), F.coalesce("text", F.lit("")).alias("text"))
    rows = df.groupBy(*page).agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def goes_on(p: Column, x: Column) -> Column:
        size, gap = x["size"], x["y0"] - p["y1"]
        beside = (F.abs(x["x0"] - p["x0"]) < 3 * size) & (gap > -0.5 * size) & (gap < 0.8 * size)
        new = (x["x0"] > p["x0"] + 0.5 * size) | (p["x1"] < x["x1"] - 2 * size)
        return x["label"].isin("paragraph", "list") & (x["label"] == p["label"]) & beside & ((x["label"] == "list") | ~new)

    def joined(p: Column, x: Column) -> Column:
        box = (F.least(p["x0"], x["x0"]), F.least(p["y0"], x["y0"]), F.greatest(p["x1"], x["x1"]), F.greatest(p["y1"], x["y1"]))
        return F.struct(p["ord"].alias("ord"), p["label"].alias("label"), *(v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)), p["size"].alias("size"), F.concat_ws("\n", p["text"], x["text"]).alias("text"))

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        on = F.coalesce(goes_on(last, x), F.lit(False))
        return F.when(on, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined(last, x)))).otherwise(F.concat(acc, F.array(x)))

    return rows.select(*page, F.explode(F.aggregate("lines", F.array().cast(f"array<{LINE}>"), step)).alias("e")).select(*page, "e.ord", "e.label", "e.x0", "e.y0", "e.x1", "e.y1", "e.text")


def page_char_errors(found: DataFrame, truth: DataFrame, page: list[str], excluded: tuple[str, ...] = ("table", "figure", "math")) -> DataFrame:
    """(page, errors, chars, extra_chars): edit distance of found lines to the true text of the smallest block around their middles.

    Found elements (ord, box, text) are cut into lines of equal height; lines
    in an excluded element don't count, those in no element are wrong as a
    whole. A block's lines go from row to row, a row's from left to right.
    """
    out = F.coalesce(F.col("label"), F.col("kind")).isin(*excluded) | F.col("kind").isin(*excluded)
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    text = F.coalesce("text", F.lit("")).alias("text")
    f = F.struct(F.col("ord").cast("long").alias("ord"), *box, text)
    g = F.struct(F.col("ord").cast("long").alias("ord"), *box, text, out.alias("out"))
    kinds = ["struct<ord:bigint,x0:double,y0:double,x1:double,y1:double,text:string>", "struct<ord:bigint,x0:double,y0:double,x1:double,y1:double,text:string,out:boolean>"]
    none = [F.lit(None).cast(kind) for kind in kinds]
    # A page is one row with all it needs: no join is made, and many pages share an Arrow batch.
    sides = found.select(*page, f.alias("f"), none[1].alias("g")).unionByName(truth.where(out | (F.coalesce("text", F.lit("")) != "")).select(*page, none[0].alias("f"), g.alias("g")))
    pages = sides.groupBy(*page).agg(F.collect_list("f").alias("found"), F.collect_list("g").alias("truth"))
    names = ("errors", "chars", "extra_chars")
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in pages.select(*page).dtypes), *(f"{c} long" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            rows = [characters.rows_of(batch, "found", ("ord", "x0", "y0", "x1", "y1", "text")), characters.rows_of(batch, "truth", ("ord", "x0", "y0", "x1", "y1", "text", "out"))]
            for i, (own, true) in enumerate(zip(*rows, strict=True)):
                e = errors_of_page(own, true)
                if e:
                    at.append(i)
                    made.append(e)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in page), *(pa.array([e[k] for e in made], pa.int64()) for k in range(len(names)))], names=[*page, *names])

    return pages.mapInArrow(run, schema)


def errors_of_page(found: list[tuple], truth: list[tuple]) -> tuple[int, int, int] | None:
    """Errors, characters and those of no element of one page; None if it has no block and no such line."""
    shown = lambda t: "".join(t.split())
    # Of the boxes around a point the first one is the smallest.
    sized = sorted(truth, key=lambda e: (max(e[3] - e[1], 0) * max(e[4] - e[2], 0), e[0]))
    out, blocks = ([e for e in sized if e[6] is x] for x in (True, False))
    outside, inside = (np.array([e[1:5] for e in es], dtype=float).reshape(-1, 4).T for es in (out, blocks))
    around = lambda b, x, y: np.flatnonzero((b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3]))
    own: dict[int, list[tuple]] = {}
    lost = extra = 0
    for o, x0, y0, x1, y1, text in found:
        texts = [t for t in map(shown, text.split("\n")) if t]
        for k, t in enumerate(texts):
            h = (y1 - y0) / len(texts)
            x, y = (x0 + x1) / 2, y0 + h * (k + 0.5)
            if out and len(around(outside, x, y)):
                continue
            hit = around(inside, x, y) if blocks else ()
            if len(hit):
                own.setdefault(int(hit[0]), []).append((y, o, k, x0, h, t))
            else:
                lost, extra = lost + 1, extra + len(t)
    if not blocks and not lost:
        return None
    errors = chars = 0
    for i, b in enumerate(blocks):
        lines = sorted(own.get(i, ()))
        heights = sorted(x[4] for x in lines)
        half = (heights[(len(lines) - 1) // 2] * 0.5 + heights[len(lines) // 2] * 0.5) / 2 if lines else 0.0
        row, placed = 0, []
        for before, x in zip([None, *lines], lines, strict=False):
            row += before is not None and x[0] - before[0] > half
            placed.append((row, x[3], *x[:3], x[5]))
        true = shown(b[5])
        errors += distance(true, "".join(x[5] for x in sorted(placed)))
        chars += len(true)
    return errors + extra, chars, extra


def reindented(chars: DataFrame, block: list[str]) -> DataFrame:
    """(block, text) of code from its characters (row, i, c, x0, x1, size): rows begin with as many blanks as their indent has widths of a character, small line numbers go, rows without anything visible too.

    A width is the median step between visible neighbours of a row, or of the
    characters themselves if there is none.
    """
    row = [*block, "row"]
    blank, digit = F.col("c").rlike(r"(?U)^\s$"), F.col("c").rlike(r"(?U)^\d$")
    d = chars.withColumn("blank", blank).withColumn("big", F.coalesce(F.max(F.when(~blank & ~digit, F.col("size"))).over(Window.partitionBy(*row)), F.lit(0)))
    number = F.col("blank") | (digit & (F.col("size") < 0.85 * F.col("big")))
    d = d.withColumn("first", F.min(F.when(~number, F.col("i"))).over(Window.partitionBy(*row))).where("i >= first")
    before = Window.partitionBy(*row).orderBy("i")
    step = F.when(~F.lag("blank").over(before) & ~F.col("blank") & (F.col("x0") > F.lag("x0").over(before)), F.col("x0") - F.lag("x0").over(before))
    d = d.withColumn("step", step)
    rows = d.groupBy(*row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "").alias("shown"), F.min_by("x0", "i").alias("x0"))
    sizes = d.groupBy(*block).agg(F.coalesce(F.median("step"), F.median(F.when(~F.col("blank"), F.col("x1") - F.col("x0")))).alias("width"))
    lefts = rows.groupBy(*block).agg(F.min("x0").alias("left"))
    indent = F.bround((F.col("x0") - F.col("left")) / F.when(F.col("width") > 0, F.col("width")).otherwise(1.0), 0).cast("int")
    line = F.concat(F.repeat(F.lit(" "), indent), "shown")
    out = rows.join(sizes, block).join(lefts, block).select(*block, F.struct("row", line.alias("line")).alias("e"))
    return out.groupBy(*block).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["line"]), "\n").alias("text"))


ROW = "struct<ord:bigint,kind:string,x0:double,y0:double,x1:double,y1:double,size:double,font:string,baseline:double,col:int,tiny:boolean,head:boolean,indented:boolean>"
GROUP = f"struct<kind:string,x0:double,y0:double,x1:double,y1:double,left:double,col:int,last:{ROW},ords:array<bigint>>"
# Fixed values, in sizes of characters.
LINE_GAP, LIST_GAP, MATH_GAP, CODE_PITCH, SIZE_SHARE, INDENT = 0.8, 1.3, 1.2, 1.8, 1.15, 0.5


def row_groups(df: DataFrame, page: list[str], gaps: tuple[float, float, float] = (LINE_GAP, LIST_GAP, MATH_GAP), pitch: float = CODE_PITCH, indent: float = INDENT) -> DataFrame:
    """(page, ord, block) of rows in reading order, each of which goes on the block before it or begins one.

    df has ord, kind (text, math or code), a box, size, font, baseline, tiny (a
    scrap of a formula), head (begins with a list's mark), indented (from its
    column's margin), col (1 or 2 of two columns, else 0) and the page's body size. What a block is is told by its
    first row. All need a box beside the block's and a gap that is small for
    their size: formulas take formulas and scraps; code takes code, by gap or by
    pitch of baselines; lists take items and what is indented beyond their mark;
    text takes rows of its size and font that are not indented.
    """
    line_gap, list_gap, math_gap = gaps
    numbers = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "size")]
    row = F.struct(F.col("ord").cast("bigint").alias("ord"), "kind", *numbers, F.coalesce("font", F.lit("")).alias("font"), F.col("baseline").cast("double").alias("baseline"), F.col("col").cast("int").alias("col"), "tiny", "head", "indented")
    pages = df.groupBy(*page).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max(F.col("body").cast("double")).alias("body"))
    body = F.col("body")

    def goes_on(g: Column, r: Column) -> Column:
        p, math = g["last"], g["kind"] == "math"
        gap = r["y0"] - p["y1"]
        reach = F.when(math, 3 * body).otherwise(0.0)
        beside = (r["x0"] < g["x1"] + reach) & (r["x1"] > g["x0"] - reach)
        unit = F.greatest(body, p["size"], r["size"])
        alike = (F.greatest(r["size"], p["size"]) <= SIZE_SHARE * F.least(r["size"], p["size"])) & ((r["font"] == p["font"]) | (r["font"] == "") | (p["font"] == ""))
        step = r["baseline"] - p["baseline"]
        code = (r["kind"] == "code") & ((gap <= line_gap * unit) | ((step > 0) & (step <= pitch * F.greatest(r["size"], p["size"]))))
        item = alike & (gap <= F.when(r["head"], list_gap).otherwise(line_gap) * unit) & (r["head"] | (r["x0"] > g["left"] + 0.3 * body))
        text = alike & (gap <= line_gap * unit) & ~r["head"] & ~r["indented"] & (r["x0"] <= g["x0"] + indent * body)
        plain = r["kind"] == "text"
        of_kind = F.when(math, (gap >= -2 * body) & (gap <= math_gap * body) & ((r["kind"] == "math") | r["tiny"])).when(gap < -0.5 * body, False).when(g["kind"] == "code", code).when(g["kind"] == "list", plain & item).otherwise(plain & text)
        across = (g["col"] + r["col"] == 3) & (g["col"] != 0) & (r["col"] != 0)
        return beside & ~across & of_kind

    def begun(r: Column) -> Column:
        kind = F.when((r["kind"] == "text") & r["head"], "list").otherwise(r["kind"])
        return F.struct(kind.alias("kind"), *(r[c].alias(c) for c in ("x0", "y0", "x1", "y1")), r["x0"].alias("left"), r["col"].alias("col"), r.alias("last"), F.array(r["ord"]).alias("ords"))

    def grown(g: Column, r: Column) -> Column:
        ends = [f(g[c], r[c]).alias(c) for c, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))]
        return F.struct(g["kind"].alias("kind"), *ends, g["left"].alias("left"), F.when(g["col"] == r["col"], g["col"]).otherwise(0).alias("col"), r.alias("last"), F.concat(g["ords"], F.array(r["ord"])).alias("ords"))

    def step(acc: Column, r: Column) -> Column:
        g = F.get(acc, F.size(acc) - 1)
        return F.when(F.coalesce(goes_on(g, r), F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown(g, r)))).otherwise(F.concat(acc, F.array(begun(r))))

    groups = pages.select(*page, F.posexplode(F.aggregate("rows", F.array().cast(f"array<{GROUP}>"), step)).alias("block", "g"))
    return groups.select(*page, "block", F.explode("g.ords").alias("ord"))


def true_elements(glyphs: DataFrame, regions: DataFrame, page: list[str], order: list[str], tolerance: float = 5.0) -> DataFrame:
    """(page, region, place, label, box, text) of the elements that regions of a page hold.

    A region (region, kind, top, bottom, column, middle, label) takes the
    glyphs (order, c, box, baseline) whose baseline is in its band, and whose
    middle is in its column if it has one. What headers (hd), page numbers (pn)
    and blocks across columns (wide) take is not in other blocks. A line ends
    where the baseline changes; blanks around it go, and don't count in boxes.
    A region without a visible glyph has no element. Headers come first and
    page numbers last.
    """
    own = regions.select(*page, "region", "kind", "top", "bottom", "column", "middle", "label")
    side = ((F.col("x0") + F.col("x1")) / 2 >= F.col("middle")).cast("int")
    hits = glyphs.join(own, page).where(F.col("baseline").between(F.col("top") - tolerance, F.col("bottom") + tolerance) & (F.col("column").isNull() | (side == F.col("column"))))
    first = F.col("kind").isin("hd", "pn", "wide")
    hits = hits.withColumn("kept", F.max(first.cast("int")).over(Window.partitionBy(*page, *order))).where(first | (F.col("kept") == 0))
    by = [*page, "region"]
    change = F.abs(F.col("baseline") - F.lag("baseline").over(Window.partitionBy(*by).orderBy(*order))) > tolerance
    lines = layout.islands(hits.withColumn("change", change), by, order, F.col("change"), "line")
    visible = ~F.col("c").rlike(r"(?U)^\s*$")
    ends = [f(F.when(visible, F.col(c))).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", *order, "c"))), lambda x: F.struct(x["line"].alias("line"), x["c"].alias("c")))
    g = lines.groupBy(*by).agg(F.first("kind").alias("kind"), F.first("label").alias("label"), *ends, F.max("line").alias("last"), texts.alias("cs")).where("x0 is not null")
    line = lambda n: strip(F.array_join(F.transform(F.filter("cs", lambda x: x["line"] == n), lambda x: x["c"]), ""))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("last").cast("int")), line), "\n")
    rank = F.when(F.col("kind") == "hd", 0).when(F.col("kind") == "pn", 2).otherwise(1)
    place = F.row_number().over(Window.partitionBy(*page).orderBy(rank, "region"))
    return g.select(*by, place.alias("place"), "label", "x0", "y0", "x1", "y1", text.alias("text"))
