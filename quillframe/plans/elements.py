"""Files written and read again, recognised words, predicates of boxes, titles, and a running scoreboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import geometry, text
from quillframe.functions.geometry import Box
from quillframe.operators import documents, layout, matching, ocr
from quillframe.plans.tables import PAGE, Tables, query
from quillframe.sources import documents as ir
from quillframe.sources import files
from quillframe.streaming import scoreboard

LABEL_LIST = ", ".join(f"'{x}'" for x in text.LABELS)


def as_documents(t: Tables) -> DataFrame:
    """The elements as nested documents; every third is of an older version."""
    box = F.array(*(F.col(c) / s for c, s in (("x0", 1000.0), ("y0", 1000.0), ("x1", 1000.0), ("y1", 1000.0))))
    e = F.struct("ord", "kind", box.alias("bbox"), "text", (F.col("size2") / 2.0).alias("font_size"), F.when(F.col("bold"), True).alias("bold"), "label", "level", F.lit("auto").alias("label_source"))
    pages = t.gt.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(e)).alias("elements"))
    pages = pages.select("doc_id", F.struct("page", F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), F.lit("px").alias("unit"), F.transform("elements", lambda x: x.dropFields("ord")).alias("elements")).alias("p"))
    d = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    return d.select(F.col("doc_id").cast("string").alias("source"), F.lit("lines").alias("extractor"), F.create_map(F.lit("dpi"), F.lit("72")).alias("params"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(4).alias("ir_version"), "pages")


@query("select cast(doc_id as varchar) as source, cast(page as bigint) as page, cast(row_number() over (partition by doc_id, page order by ord) - 1 as bigint) as ord, kind, label, level, case when bold then true end as bold, size2 / 2.0 as font_size, x0 / 1000.0 as x0, y1 / 1000.0 as y1, md5(text) as text from gt")
def ir_roundtrip(t: Tables) -> DataFrame:
    """All elements written as document JSON, read with checks and flattened."""
    folder = files.shared_folder(t.spark, "ir")
    ir.save_json(as_documents(t), folder)
    e = ir.elements(ir.load_documents(t.spark, folder, check=True))
    return e.select("source", "page", "ord", "kind", "label", "level", "bold", "font_size", "x0", "y1", F.md5(F.encode("text", "UTF-8")).alias("text"))


@query(f"""
, b as (select doc_id, case when ord % 19 = 3 then 'verse' else label end as label, case when ord % 23 = 5 then 'guess' else 'manual' end as source, case when ord % 29 = 7 then x0 else x1 end as x1, x0, ord % 31 = 8 as short from gt),
m as (select doc_id, 'label is unknown' as problem from b where label not in ({LABEL_LIST}) union all select doc_id, 'source is unknown' from b where source <> 'manual' union all select doc_id, 'box has not four numbers' from b where short
  union all select doc_id, 'box is turned left to right' from b where not short and x0 >= x1)
select cast(doc_id as varchar) as pdf, problem, count(*) as n from m group by doc_id, problem""")
def label_roundtrip(t: Tables) -> DataFrame:
    """All elements written as label files, some with faults, read again and checked."""
    x1 = F.when(F.col("ord") % 29 == 7, F.col("x0")).otherwise(F.col("x1"))
    box = F.array(*(c.cast("double") for c in (F.col("x0"), F.col("y0"), x1, F.col("y1"))))
    b = F.struct(F.col("ord"), (F.col("page") - 1).alias("page"), F.when(F.col("ord") % 31 == 8, F.slice(box, 1, 3)).otherwise(box).alias("bbox"), F.when(F.col("ord") % 19 == 3, "verse").otherwise(F.col("label")).alias("label"), "text", F.when(F.col("ord") % 23 == 5, "guess").otherwise("manual").alias("source"))
    folder = files.shared_folder(t.spark, "labels")
    d = t.gt.groupBy(F.col("doc_id").cast("string").alias("pdf")).agg(F.transform(F.array_sort(F.collect_list(b)), lambda x: x.dropFields("ord")).alias("blocks"))
    ir.save_json(d, folder)
    back = ir.load(t.spark, folder, ir.LABEL_FILE).select("pdf", F.explode("blocks").alias("b"))
    return back.select("pdf", F.explode(ir.label_problems(F.col("b"))).alias("problem")).groupBy("pdf", "problem").agg(F.count("*").alias("n"))


@query("""
, r as (select event_id, event_type, 'd' || cast(user_id % 3 as varchar) as dataset, value, user_id from events)
select cast(event_id as varchar) as run_id, event_type as model, dataset, value as score, case when user_id % 4 = 0 then 0 else user_id % 4 end as errors from r""")
def latest_reports(t: Tables) -> DataFrame:
    """Every event written as a report and read again; reports without errors lack the key."""
    e = t.table("events").select(F.col("event_id").cast("string").alias("run_id"), F.struct(F.col("event_type").alias("id"), F.col("event_type").alias("name")).alias("model"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"), F.create_map(F.lit("f1"), "value").alias("summary"), F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4).alias("errors"))
    folder = files.shared_folder(t.spark, "reports")
    ir.save_json(e, folder)
    return ir.load(t.spark, folder, ir.REPORT).select("run_id", F.col("model.id").alias("model"), "dataset", F.col("summary")["f1"].alias("score"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query("select doc_id, md5(text) as text, case when n_chars is not null then n_chars end as n_chars from documents where text is not null and text <> ''")
def csv_roundtrip(t: Tables) -> DataFrame:
    """Texts with their quotes, commas and lines, written as CSV and read again."""
    folder = files.shared_folder(t.spark, "csv")
    files.save_csv(t.table("documents").where("text is not null and text <> ''").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("text"), "n_chars"), folder)
    back = files.load_csv(t.spark, folder, "doc_id long, text string, n_chars long")
    return back.select("doc_id", F.md5(F.unbase64("text")).alias("text"), "n_chars")


@query("select cast(doc_id as varchar) || '-' || cast(ord as varchar) || '.png' as file, md5(text || chr(9) || 'x') as latex from lines where strpos(text, chr(13)) = 0")
def tsv_labels(t: Tables) -> DataFrame:
    """Lines written as file, tab and formula, with a tab within the formula, and read again."""
    folder = files.shared_folder(t.spark, "tsv")
    rows = t.lines.where(~F.col("text").contains("\r")).select(F.concat_ws("\t", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("ord").cast("string"), F.lit(".png")), "text", F.lit("x")).alias("value"))
    rows.write.text(folder)
    return files.load_labels_tsv(t.spark, folder).select("file", F.md5(F.encode("latex", "UTF-8")).alias("latex"))


TEX_SOURCE = r"concat('% $no$', chr(10), '\begin{document} $a_', cast(doc_id as varchar(9)), '$ \% ', coalesce(replace(replace(replace(text, '$', ''), '\', ''), '%', ''), ''), chr(10), '\[ x^', cast(doc_id % 7 as varchar(9)), ' \] % \[gone\]', chr(10), '\begin{verbatim}$v$\end{verbatim} \begin{align*}b\end{align*} \(c\) $ $')"


@query(r"""
, f as (select doc_id, unnest([{'o': 0, 'd': true, 'l': 'x^' || cast(doc_id % 7 as varchar)}, {'o': 1, 'd': true, 'l': 'b'}, {'o': 2, 'd': false, 'l': 'a_' || cast(doc_id as varchar)}, {'o': 3, 'd': false, 'l': 'c'}]) as x from documents)
select doc_id as source, cast(x.o as bigint) as ord, x.d as display, x.l as latex from f""")
def tex_source_formulas(t: Tables) -> DataFrame:
    """The four formulas of a TeX source made of each document."""
    d = t.table("documents").select(F.col("doc_id").alias("source"), F.expr(TEX_SOURCE.replace("\\", "\\\\")).alias("text"))
    return files.tex_formulas(d)


@query("""
, p as (select doc_id, page, ord, x0, y0, x1, y1, lead(x0) over w as a0, lead(y0) over w as b0, lead(x1) over w as a1, lead(y1) over w as b1 from pred window w as (partition by doc_id, page order by ord)),
q as (select *, greatest(least(y1, b1) - greatest(y0, b0), 0) as v, greatest(y1, b1) - least(y0, b0) as hull from p where a0 is not null)
select doc_id, cast(page as bigint) as page, ord, round(v / cast(hull as double), 6) as iou_1d, x1 + 2 > a0 and a1 + 2 > x0 and y1 + 2 > b0 and b1 + 2 > y0 as overlaps, x0 >= a0 - 2 and x1 <= a1 + 2 and y0 >= b0 - 2 and y1 <= b1 + 2 as inside,
  (least(y1, b1) - greatest(y0, b0)) * 2 > least(y1 - y0, b1 - b0) as same_row, y1 - y0 >= 1.5 * (x1 - x0) as vertical, case when x1 <= 510 then 1 when x0 >= 490 then 2 else 0 end as col,
  case when x1 - x0 >= 10 and y1 - y0 >= 10 then cast(greatest(0, least(1000, x0 - 4)) as bigint) end as crop from q""")
def box_predicates(t: Tables) -> DataFrame:
    """Each predicted box against the next of its page: how far they share rows, overlap, hold each other; and its column, direction and crop."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    p = t.pred.select(*PAGE, "ord", "x0", "y0", "x1", "y1", *(F.lead(c).over(w).alias(f"n_{c}") for c in ("x0", "y0", "x1", "y1"))).where("n_x0 is not null")
    a, b = Box.of(), Box.of("n_")
    share = Box(*(c / 1000.0 for c in (a.x0, a.y0, a.x1, a.y1)))
    return p.select(*PAGE, "ord", F.round(geometry.iou_1d(a.y0, a.y1, b.y0, b.y1), 6).alias("iou_1d"), geometry.overlaps(a, b, 2).alias("overlaps"), geometry.is_inside(a, b).alias("inside"), geometry.same_row(a, b).alias("same_row"), geometry.is_vertical(a).alias("vertical"), geometry.column_of(a, F.lit(500)).alias("col"), F.round(geometry.padded(share, 0.004, 0.00999999)["x0"] * 1000).cast("long").alias("crop"))


@query("""
, v as (select doc_id, page, avg(case when y1 - y0 >= 1.5 * (x1 - x0) then 1.0 else 0.0 end) as share from (select doc_id, page, x0, case when (doc_id + page) % 2 = 0 then x0 + 5 + ord % 2 * 300 else x1 end as x1, y0, y1 from gt) as x group by doc_id, page)
select doc_id, cast(page as bigint) as page, round(share, 6) as share, share >= 0.5 as vertical from v""")
def vertical_pages(t: Tables) -> DataFrame:
    """Pages at least half of whose boxes are vertical; on every other page boxes are made narrow."""
    x1 = F.when((F.col("doc_id") + F.col("page")) % 2 == 0, F.col("x0") + 5 + F.col("ord") % 2 * 300).otherwise(F.col("x1"))
    g = t.gt.withColumn("x1", x1).groupBy(*PAGE).agg(F.avg(geometry.is_vertical(Box.of()).cast("int")).alias("share"))
    return g.select(*PAGE, F.round("share", 6).alias("share"), (F.col("share") >= 0.5).alias("vertical"))


@query("""
select page_id, case page_id % 4 when 0 then 'pdf' when 1 then 'png' when 2 then 'jpg' end as kind from pages""")
def file_kinds(t: Tables) -> DataFrame:
    """Kinds by the first bytes: pages' html after a signature, or bare."""
    head = F.when(F.col("page_id") % 4 == 0, F.unhex(F.lit("255044462D312E37"))).when(F.col("page_id") % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("page_id") % 4 == 2, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.encode(F.lit(""), "UTF-8"))
    return t.table("pages").select("page_id", text.file_kind(F.concat(head, F.encode(F.coalesce("html", F.lit("")), "UTF-8"))).alias("kind"))


WORDS_SQL = """
, s as (select doc_id, page, ord, string_split(text, ' ') as ws, y0 from gt),
w as (select doc_id, page, ord, unnest(range(len(ws))) as i, unnest(ws) as text, y0 from s),
o as (select doc_id, page, ord, i, ord * 1000 + i as n, cast(floor(ord % 40 / 20) as int) as block, cast(floor(ord % 20 / 5) as int) as par, text, 100 + 40 * i as l, y0 * 2 as t, 8 * length(text) as w, 20 + ord % 5 as h, (ord * 7 + i * 13) % 100 - 5 as conf from w)"""


def ocr_words(t: Tables) -> DataFrame:
    s = t.gt.select(*PAGE, F.col("ord").alias("line"), "y0", F.posexplode(F.split("text", " ", -1)).alias("i", "text"))
    o = F.col("line")
    return s.select(*PAGE, (o * 1000 + F.col("i")).alias("ord"), F.floor(o % 40 / 20).cast("int").alias("block"), F.floor(o % 20 / 5).cast("int").alias("par"), "line", "text", ((o * 7 + F.col("i") * 13) % 100 - 5).alias("conf"), (100 + 40 * F.col("i")).alias("left"), (F.col("y0") * 2).alias("top"), (8 * F.length("text")).alias("width"), (20 + o % 5).alias("height"))


@query(WORDS_SQL + """
, k as (select *, regexp_replace(text, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+|[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+$', '', 'g') as x from o where conf >= 0), f as (select *, lag(x) over (partition by doc_id, page, ord order by n) as before from k where x <> ''),
j as (select *, case when before is not null and regexp_matches(before, '[\\x21-\\x7E]$') and regexp_matches(x, '^[A-Za-z0-9]') then ' ' else '' end || x as piece from f),
lines2 as (select doc_id, page, block, par, ord, min(n) as n, min(l) as l, min(t) as t, max(l + w) as r, max(t + h) as b, string_agg(piece, '' order by n) as text, sum(conf) as conf, count(*) as words from j group by doc_id, page, block, par, ord),
p as (select doc_id, page, min(n) as n, min(l) as l, max(r) as r, string_agg(text, chr(10) order by n) as text, list(b - t order by b - t) as hs, sum(conf) as conf, sum(words) as words from lines2 group by doc_id, page, block, par)
select doc_id, cast(page as bigint) as page, n as ord, round(least(1, l / 4000.0), 4) as x0, md5(text) as text, hs[len(hs) // 2 + 1] / 2.0 as font_size, cast(floor(round(conf / words / 100, 4) * 100 + 0.0001) as bigint) as confidence from p where r > l""")
def ocr_elements(t: Tables) -> DataFrame:
    """Words recognised at twice the page's size, grouped into paragraphs; whole hundredths of confidence, as engines round ties differently."""
    e = ocr.word_elements(ocr_words(t), PAGE, F.lit(2000.0), F.lit(2000.0), scale=2.0)
    return e.select(*PAGE, "ord", F.round("x0", 4).alias("x0"), F.md5(F.encode("text", "UTF-8")).alias("text"), "font_size", F.floor(F.col("confidence") * 100 + 0.0001).alias("confidence"))


@query("""
, b as (select doc_id, page, ord, x0, x1, y0 - 12 as y0, y1 + 12 as y1 from gt where kind <> 'text')
select b.doc_id, cast(b.page as bigint) as page, b.ord, md5(string_agg(p.text, chr(10) order by p.ord)) as text from b left join pred p on p.doc_id = b.doc_id and p.page = b.page and (p.x0 + p.x1) / 2.0 between b.x0 and b.x1 and (p.y0 + p.y1) / 2.0 between b.y0 and b.y1 group by b.doc_id, b.page, b.ord""")
def text_in_boxes(t: Tables) -> DataFrame:
    boxes = t.gt.where("kind <> 'text'").selectExpr(*PAGE, "ord", "x0", "x1", "y0 - 12 as y0", "y1 + 12 as y1")
    return ocr.text_in_boxes(boxes, t.pred, PAGE).select(*PAGE, "ord", F.md5(F.encode("text", "UTF-8")).alias("text"))


def titled(t: Tables) -> DataFrame:
    """First pages whose upper lines are centred on documents with an even id, the second larger than the rest, the fourth a date."""
    top = F.col("ord") % 40
    centred = (F.col("doc_id") % 2 == 0) & (top < 5)
    half = F.least(F.lit(300), (F.length("text") * 4).cast("int"))
    g = t.gt.where("page = 1").select("doc_id", "ord", F.when(centred, 500 - half).otherwise(F.col("x0")).alias("x0"), "y0", F.when(centred, 500 + half).otherwise(F.col("x1")).alias("x1"), "y1", F.when(centred & (top == 1), 40).otherwise(F.col("size2")).alias("size"), F.when(centred & (top == 3), "2024/05/01").otherwise(F.substring("text", 1, 60)).alias("text"))
    return g


@query()
def title_roles(t: Tables) -> DataFrame:
    """Titles, authors and dates on first pages; tests compare with a plain loop."""
    g = titled(t)
    body = layout.weighted_mode(g.withColumn("w0", F.length("text")), ["doc_id"], "size", "w0").withColumnRenamed("size", "body")
    return documents.find_titles(g.join(body, "doc_id"), ["doc_id"], 1000.0)


@query("select event_type, cast(user_id % 7 as bigint) as shard, count(*) as n, cast(sum(cast(floor(value) as bigint)) as bigint) as errors from events group by 1, 2")
def running_scoreboard(t: Tables) -> DataFrame:
    """The events as a stream of files, summed until none is left."""
    schema = t.table("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    rows = stream.select("event_type", (F.col("user_id") % 7).alias("shard"), F.floor("value").cast("long").alias("errors"))
    return scoreboard.run_available(t.spark, rows, ["event_type", "shard"], ["errors"], files.shared_folder(t.spark, "scoreboard"))


@query("""
, x as (select lang, count(*) filter (where g_label = 'heading' and p_label = 'heading') as tp, count(*) filter (where g_label <> 'heading' and p_label = 'heading') as fp, count(*) filter (where g_label = 'heading' and p_label <> 'heading') as fn from pairs group by lang)
select lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from x""")
def heading_counts(t: Tables) -> DataFrame:
    from quillframe.plans.scoring import pairs, r6

    g, p = F.col("g_label") == "heading", F.col("p_label") == "heading"
    x = pairs(t, "label").groupBy("lang").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return x.select("lang", "tp", "fp", "fn", r6(geometry.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "precision"), r6(geometry.ratio(F.col("tp"), F.col("tp") + F.col("fn")), "recall"))


@query("""
, n as (select label, sum(a) as n_gt, sum(b) as n_pred, sum(k) as ok from (select label, 1 as a, 0 as b, 0 as k from gt union all select label, 0, 1, 0 from pred where (doc_id, page) in (select doc_id, page from gt) union all select g_label, 0, 0, case when g_label = p_label then 1 else 0 end from pairs) group by label),
f as (select label, n_gt, case when n_pred = 0 or ok = 0 then 0 else 2 * ok / (n_pred + n_gt) end as f1 from n where n_gt >= 5)
select case when f1 >= 0.85 then 'strength' else 'weakness' end as kind, 'label=' || label as slice, cast(n_gt as bigint) as n, round(f1, 6) as value from f where f1 >= 0.85 or f1 <= 0.5""")
def label_findings(t: Tables) -> DataFrame:
    """Labels with at least five true elements that are found very well or badly."""
    from quillframe.plans.scoring import label_scores, r6

    s = label_scores(t).where("n_gt >= 5 and (f1 >= 0.85 or f1 <= 0.5)")
    return s.select(F.when(F.col("f1") >= 0.85, "strength").otherwise("weakness").alias("kind"), F.concat(F.lit("label="), "label").alias("slice"), F.col("n_gt").alias("n"), r6(F.col("f1"), "value"))


@query("select doc_id, cast(page as bigint) as page, ord, md5(text) as text from gt where kind = 'text' and not exists (select 1 from gt b where b.kind <> 'text' and b.doc_id = gt.doc_id and b.page = gt.page and greatest(0, least(gt.x1, b.x1) - greatest(gt.x0, b.x0)) * greatest(0, least(gt.y1, b.y1 + 30) - greatest(gt.y0, b.y0)) * 2 >= (gt.x1 - gt.x0) * (gt.y1 - gt.y0))")
def texts_outside_figures(t: Tables) -> DataFrame:
    """Texts that no table or figure, which reach 30 further down here, covers by half."""
    regions = t.gt.where("kind <> 'text'").withColumn("y1", F.col("y1") + 30)
    return matching.absorb(t.gt.where("kind = 'text'"), regions, PAGE, 0.5).select(*PAGE, "ord", F.md5(F.encode("text", "UTF-8")).alias("text"))


def labelled_elements(t: Tables) -> DataFrame:
    """The marked lines as elements: some of two lines, some without a label."""
    g = t.gt.select("doc_id", "page", "ord", "kind", F.when(F.col("ord") % 37 != 11, F.when(F.col("ord") % 10 >= 7, F.when(F.col("ord") % 20 < 10, "list").otherwise("code")).otherwise(F.col("label"))).alias("label"), F.when(F.col("ord") % 13 == 2, F.col("level")).alias("level"), (F.col("size2") / 2).alias("size"), "x0", "x1")
    m = t.marked.select("doc_id", "ord", F.when(F.col("ord") % 9 == 4, F.concat("text", F.lit("\n  "), "text")).otherwise(F.col("text")).alias("text"))
    return g.join(m, ["doc_id", "ord"])


@query()
def document_blocks(t: Tables) -> DataFrame:
    """Elements as the blocks of documents; tests compare with a plain loop."""
    from quillframe.operators.blocks import to_blocks

    return to_blocks(labelled_elements(t))


@query("""
, c as (select t, list([a, b, c] order by r, a, b, c) as cells, count(*) as n from table_rows group by t)
select t, cast(n as bigint) as n_rows, cast(case when t % 3 = 0 then 3 else 2 end as bigint) as n_columns, md5(array_to_string(list_transform(cells, lambda x: case when t % 3 = 0 then x[1] || '|' || x[2] || '|' || x[3] else x[1] || '|' || x[2] end), '/')) as rows,
  case when t % 3 = 0 then 'lcr' else 'll' end as aligns, case when t % 2 = 0 and n = 3 then 'false,true,true,false' else array_to_string(list_transform(range(n + 1), lambda i: case when i = 0 or i = n then 'true' else 'false' end), ',') end as row_rules from c""")
def table_blocks(t: Tables) -> DataFrame:
    """Tables of order lines: alignments fit those of three columns, row rules those of three rows."""
    from quillframe.operators.blocks import table_block

    width = F.when(F.col("t") % 3 == 0, 3).otherwise(2)
    x = t.table_rows.groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.array("a", "b", "c").alias("x")))), lambda y: y["x"]).alias("cells"))
    cells = F.transform("cells", lambda r: F.slice(r, F.lit(1), width))
    rules = F.when(F.col("t") % 2 == 0, F.array(*(F.lit(v) for v in (False, True, True, False))))
    b = table_block(cells, F.array(F.lit("l"), F.lit("c"), F.lit("r")), F.lit(None).cast("array<boolean>"), rules, F.lit(None).cast("array<double>"), F.lit(0.0), F.lit(1.0))
    x = x.select("t", b.alias("b"))
    joined = F.array_join(F.transform("b.rows", lambda r: F.array_join(r, "|")), "/")
    return x.select("t", F.size("b.rows").cast("long").alias("n_rows"), F.size("b.aligns").cast("long").alias("n_columns"), F.md5(F.encode(joined, "UTF-8")).alias("rows"), F.array_join("b.aligns", "").alias("aligns"), F.array_join(F.transform("b.row_rules", lambda v: v.cast("string")), ",").alias("row_rules"))


@query("""
, d as (select distinct doc_id from gt), p as (select distinct doc_id, page from gt), m as (
  select doc_id, 'version is unknown' as problem from d where doc_id % 7 = 1 union all select distinct doc_id, 'pages are not numbered from 1' from p where doc_id % 11 = 2
  union all select doc_id, 'pages are not numbered from 1' from p where doc_id % 11 <> 2 group by doc_id having max(page) <> count(*)
  union all select distinct doc_id, 'a page has no size' from p where doc_id % 13 = 3 union all select distinct doc_id, 'a unit is unknown' from p where doc_id % 17 = 4)
select problem, count(*) as n from m group by problem""")
def document_validation(t: Tables) -> DataFrame:
    """Problems of whole documents, some of which have faults planted."""
    from quillframe.operators.validation import document_problems

    doc = F.col("source").cast("long")
    d = as_documents(t)
    broken = lambda p: F.struct((p["page"] + F.when(doc % 11 == 2, 1).otherwise(0)).alias("page"), F.when(doc % 13 == 3, 0.0).otherwise(p["width"]).alias("width"), p["height"].alias("height"), F.when(doc % 17 == 4, "in").otherwise(p["unit"]).alias("unit"))
    d = d.select(F.when(doc % 7 == 1, 9).otherwise(F.col("ir_version")).alias("v"), F.transform("pages", broken).alias("p"))
    return d.select(F.explode(document_problems(F.col("v"), F.col("p"))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("""
, r as (select doc_id, ord, text, ord % 5 = 1 as empty, ord % 7 = 2 as blank, ord % 11 = 3 as other from lines), m as (select 'a run is empty' as problem from r where empty union all select 'a run''s TeX is blank' from r where blank union all select 'runs differ from the text' from r where other)
select problem, count(*) as n from m group by problem""")
def run_validation(t: Tables) -> DataFrame:
    """Lines in two runs, some empty, with blank TeX or of another text."""
    from quillframe.operators.validation import run_problems

    o = F.col("ord")
    run = lambda text, tex: F.struct(text.alias("text"), tex.alias("tex"))
    none = F.lit(None).cast("string")
    runs = F.concat(F.array(run(F.col("text"), F.when(o % 7 == 2, " "))), F.when(o % 5 == 1, F.array(run(F.lit(""), none))).otherwise(F.array().cast("array<struct<text:string,tex:string>>")), F.when(o % 11 == 3, F.array(run(F.lit("!"), none))).otherwise(F.array().cast("array<struct<text:string,tex:string>>")))
    return t.lines.select(F.explode(run_problems(F.col("text"), runs)).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("""
, f as (select doc_id, unnest(regexp_extract_all(text, '[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]')) as x, ord from lines where ord % 4 = 0)
select doc_id, count(*) as n from f group by doc_id""")
def formula_letters(t: Tables) -> DataFrame:
    """Tokens of lines whose letters are all tokens of their own, as formulas' are, made TeX and cut up again."""
    tokens = F.regexp_extract_all("text", F.lit(r"(?U)([^\s\x1c-\x1f])"), F.lit(1))
    # A backslash would take in the letter after it: it is doubled, and counted once.
    safe = F.transform(tokens, lambda x: F.when(x == "\\", F.lit("\\\\")).otherwise(x))
    again = text.tex_tokens(text.detokenize(safe))
    return t.lines.where("ord % 4 = 0").select("doc_id", F.size(again).alias("k")).groupBy("doc_id").agg(F.sum("k").alias("n")).where("n > 0")
