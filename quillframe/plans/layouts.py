"""Order, shape and structure of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.geometry import size_class
from quillframe.operators import documents, grouping, layout
from quillframe.plans.tables import PAGE, Tables, query


@query("""
, s as (select doc_id, page, size2, sum(length(text)) as w, min(ord) as f from gt group by doc_id, page, size2), n as (select *, row_number() over (partition by doc_id, page order by w desc, f) as n from s)
select doc_id, cast(page as bigint) as page, size2 from n where n = 1""")
def weighted_mode_body_size(t: Tables) -> DataFrame:
    return layout.weighted_mode(t.gt.withColumn("w0", F.length("text")), PAGE, "size2", "w0")


@query("""
, s as (select doc_id, page, size2, sum(length(text)) as w from gt group by doc_id, page, size2), c as (select *, sum(w) over (partition by doc_id, page order by size2) as so_far, sum(w) over (partition by doc_id, page) as whole from s)
select doc_id, cast(page as bigint) as page, min(size2) as size2 from c where 2 * so_far >= whole group by doc_id, page""")
def weighted_median_body_size(t: Tables) -> DataFrame:
    return layout.weighted_median(t.gt.withColumn("w0", F.length("text")), PAGE, "size2", "w0")


@query("""
, n as (select doc_id, page, x1, row_number() over (partition by doc_id, page order by x1) as n, count(*) over (partition by doc_id, page) as k from gt),
m as (select doc_id, page, median(x1) as median from gt group by doc_id, page)
select doc_id, cast(page as bigint) as page, cast(x1 as bigint) as upper, median from n join m using (doc_id, page) where n = k // 2 + 1""")
def medians(t: Tables) -> DataFrame:
    upper = layout.upper_median(t.gt, PAGE, "x1").withColumnRenamed("x1", "upper")
    return upper.join(t.gt.groupBy(*PAGE).agg(F.median("x1").alias("median")), PAGE)


@query("select doc_id, text as header, count(distinct page) as n_pages from (select doc_id, page, text from gt where ord % 40 < 6) group by doc_id, text having count(distinct page) >= 2")
def repeated_headers(t: Tables) -> DataFrame:
    rows = t.gt.select(*PAGE, "ord", F.col("text").alias("header"))
    return layout.repeated_headers(rows, "doc_id", "page", "header", F.col("ord") % 40 < 6)


@query("""
, n as (select doc_id, page, count(*) filter (where col = 1) as "left", count(*) filter (where col = 2) as "right", count(*) filter (where col = 0) as across from columns where x1 - x0 >= 150 group by doc_id, page)
select doc_id, cast(page as bigint) as page, "left", "right", across, "left" >= 1 and "right" >= 1 and "left" + "right" >= 4 and across * 3 <= "left" + "right" as two_columns from n""")
def two_column_pages(t: Tables) -> DataFrame:
    return layout.two_column_pages(t.columns, PAGE, "col", F.col("x1") - F.col("x0") >= 150)


@query("""
, b as (select *, sum(case when col = 0 then 1 else 0 end) over (partition by doc_id, page order by top range between unbounded preceding and current row) as band from columns)
select doc_id, cast(page as bigint) as page, ord, cast(band as bigint) as band, row_number() over (partition by doc_id, page order by band, col, top, ord) as place from b""")
def banded_reading_order(t: Tables) -> DataFrame:
    return layout.banded_order(t.columns, PAGE, "col", "top", ["ord"]).select(*PAGE, "ord", "band", "place")


@query("""
, c as (select doc_id, page, ord, y0 - ord % 3 * 20 + (ord * 5) % 11 as center, 10 + ord % 4 * 10 as size from gt),
g as (select *, center - lag(center) over (partition by doc_id, page order by center, ord) as gap, median(size) over (partition by doc_id, page) / 2 as half from c)
select doc_id, cast(page as bigint) as page, ord, cast(sum(case when gap > half or gap is null then 1 else 0 end) over (partition by doc_id, page order by center, ord rows unbounded preceding) as bigint) as row from g""")
def row_islands_by_gap(t: Tables) -> DataFrame:
    return layout.rows_by_gap(in_rows(t), PAGE, "center", "size").select(*PAGE, "ord", "row")


def in_rows(t: Tables) -> DataFrame:
    """All elements, with centres of up to three neighbours close together, so that rows have one element or more."""
    return t.gt.selectExpr(*PAGE, "ord", "y0 - ord % 3 * 20 + (ord * 5) % 11 as center", "10 + ord % 4 * 10 as size")


@query("select doc_id, ord, least(3, coalesce(case when ord % 17 = 4 then 2 end, dense_rank() over (partition by doc_id order by size2 desc))) as level from gt where label = 'heading'")
def heading_rank_levels(t: Tables) -> DataFrame:
    h = t.gt.where("label = 'heading'").select("doc_id", "ord", (F.col("size2") / 2).alias("size"), F.when(F.col("ord") % 17 == 4, 2).alias("explicit"))
    return layout.heading_ranks(h, ["doc_id"], "size", "explicit").select("doc_id", "ord", F.col("level_found").alias("level"))


@query("""
, c as (select *, case when lag(role) over w is distinct from role or row_number() over w = 1 then 1 else 0 end as new from conversations window w as (partition by conv_id order by turn)),
r as (select *, sum(new) over (partition by conv_id order by turn rows unbounded preceding) as run from c)
select conv_id, cast(run as bigint) as run, role, count(*) as n, min(turn) as first, cast(sum(length(text)) as bigint) as chars from r group by conv_id, run, role""")
def consecutive_merge_blocks(t: Tables) -> DataFrame:
    r = layout.runs(t.table("conversations"), ["conv_id"], "turn", ["role"])
    return r.groupBy("conv_id", "run", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.sum(F.length("text")).alias("chars"))


@query("""
, c as (select *, case when lag(bold) over w is distinct from bold then 1 else 0 end as new from gt window w as (partition by doc_id order by ord)), r as (select *, sum(new) over (partition by doc_id order by ord rows unbounded preceding) as run from c)
select doc_id, cast(run as bigint) as run, bold, min(ord) as first, md5(string_agg(text, '' order by ord)) as text from r group by doc_id, run, bold""")
def run_length_segments(t: Tables) -> DataFrame:
    r = layout.runs(t.gt, ["doc_id"], "ord", ["bold"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return r.groupBy("doc_id", "run", "bold").agg(F.min("ord").alias("first"), F.md5(F.encode(whole, "UTF-8")).alias("text"))


@query("""
, i as (select doc_id, page, y0, y1 + (ord * 5) % 11 * 3 as y1 from gt), c as (select doc_id, page, y0, max(y1) over (partition by doc_id, page order by y0, y1 rows between unbounded preceding and 1 preceding) as covered from i)
select doc_id, cast(page as bigint) as page, (y0 + covered) / 2.0 as cut from c where y0 > covered""")
def interval_gap_cuts(t: Tables) -> DataFrame:
    return layout.gap_cuts(overlapping(t), PAGE, "y0", "y1")


def overlapping(t: Tables) -> DataFrame:
    """All elements, up to 50 high, so that some reach over the next one or two."""
    return t.gt.selectExpr(*PAGE, "ord", "y0", "y1 + (ord * 5) % 11 * 3 as y1")


@query("""
, p as (select doc_id, ord, (doc_id * 31 + ord * 17) % 100 / 100.0 >= 0.5 as inside from gt), c as (select *, case when lag(inside) over w is distinct from inside then 1 else 0 end as new from p window w as (partition by doc_id order by ord)),
r as (select *, sum(new) over (partition by doc_id order by ord rows unbounded preceding) as run from c)
select doc_id, min(ord) as start, max(ord) + 1 as stop from r where inside group by doc_id, run""")
def spans_from_threshold(t: Tables) -> DataFrame:
    return layout.spans_from_probabilities(t.gt.selectExpr("doc_id", "ord", "(doc_id * 31 + ord * 17) % 100 / 100.0 as p"), ["doc_id"], "ord", "p", 0.5)


@query("""
, h as (select doc_id, page, ord, x1 - x0 as h, avg(x1 - x0) over (partition by doc_id, page) as a from gt)
select doc_id, cast(page as bigint) as page, ord, case when h > 1.5 * a then 'large' when h < 0.7 * a then 'small' else 'medium' end as size from h""")
def size_classes(t: Tables) -> DataFrame:
    h = F.col("x1") - F.col("x0")
    return t.gt.select(*PAGE, "ord", size_class(h, F.avg(h).over(Window.partitionBy(*PAGE))).alias("size"))


@query("select doc_id, cast(page as bigint) as page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from gt group by doc_id, page")
def page_hulls(t: Tables) -> DataFrame:
    from quillframe.functions.geometry import union_box

    return t.gt.groupBy(*PAGE).agg(*union_box())


@query("""
, w as (select doc_id, page, ord, y0 - lag(y1) over p as above, lead(y0) over p - y1 as below, size2 / lag(size2) over p as ratio, lag(label) over p as before from gt window p as (partition by doc_id, page order by ord))
select doc_id, cast(page as bigint) as page, ord, coalesce(above, 20) as above, coalesce(below, 20) as below, round(coalesce(ratio, 1), 6) as ratio, coalesce(before, 'none') as before from w""")
def neighbour_features(t: Tables) -> DataFrame:
    """Gaps, size ratio and kind of the neighbours; 20 and 1 where there is none."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    c = F.col
    return t.gt.select(*PAGE, "ord", F.coalesce(c("y0") - F.lag("y1").over(w), F.lit(20)).alias("above"), F.coalesce(F.lead("y0").over(w) - c("y1"), F.lit(20)).alias("below"), F.round(F.coalesce(c("size2") / F.lag("size2").over(w), F.lit(1.0)), 6).alias("ratio"), F.coalesce(F.lag("label").over(w), F.lit("none")).alias("before"))


@query("""
, e as (select a.doc_id, a.page, a.ord as a, b.ord as b from gt a join gt b on a.doc_id = b.doc_id and a.page = b.page and a.ord <> b.ord and greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 4 and greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 4 where a.kind = 'text' and b.kind = 'text'),
reach as (select doc_id, page, ord as a, ord as b from gt where kind = 'text' union select r.doc_id, r.page, r.a, e.b from reach r join e on e.doc_id = r.doc_id and e.page = r.page and e.a = r.b)
select doc_id, cast(page as bigint) as page, a as ord, min(b) as fragment from reach group by doc_id, page, a""")
def fragment_components(t: Tables) -> DataFrame:
    """Transitive closure of near boxes: a page's boxes, which are few, meet in one group."""
    return grouping.near_components(t.gt.where("kind = 'text'"), PAGE, 4)


def scattered(t: Tables) -> DataFrame:
    """All elements, with gaps of -12 to 68 between neighbours, so that clusters have one element or many."""
    return t.gt.selectExpr(*PAGE, "ord", "x0 + ord % 3 * 40 as x0", "y0 * 2 + (doc_id * 7 + ord * ord * 3) % 41 as y0", "x1 + ord % 3 * 40 as x1", "y0 * 2 + (doc_id * 7 + ord * ord * 3) % 41 + 20 as y1")


@query()
def figure_clusters(t: Tables) -> DataFrame:
    """Boxes merged while their hulls are near; tests compare with a plain loop."""
    return grouping.merge_boxes(scattered(t), PAGE, 30)


@query()
def text_blocks(t: Tables) -> DataFrame:
    """Lines grouped into blocks; tests compare with a plain loop."""
    return grouping.line_blocks(t.gt, PAGE)


@query()
def caption_attach(t: Tables) -> DataFrame:
    """Captions and the tables or figures beside them; tests compare with a plain loop."""
    return documents.attach_captions(t.gt, PAGE)


@query("""
, k as (select label from gt)
select case when label in ('list', 'math') then 'paragraph' when label in ('title', 'author', 'date') then 'other' else label end as coarse, count(*) as n from k group by coarse""")
def coarse_label_rollup(t: Tables) -> DataFrame:
    from quillframe.functions.text import coarse

    return t.gt.groupBy(coarse(F.col("label")).alias("coarse")).agg(F.count("*").alias("n"))


FAULTY = "doc_id, ord, case when ord % 23 = 1 then 'text box' else kind end as kind, case when ord % 29 = 2 then 'verse' else label end as label, case when ord % 31 = 3 then 4 else level end as level, x0, case when ord % 37 = 4 then x0 - 1 else x1 end as x1, y0, y1, case when ord % 41 = 5 then null else text end as text"


@query(f"""
, e as (select {FAULTY} from gt),
m as (select case when kind not in ('text', 'table', 'figure') then 'kind is unknown' end as m from e union all select case when x0 >= x1 or y0 >= y1 then 'box is empty or inverted' end from e
  union all select case when kind = 'text' and text is null then 'text is missing' end from e union all select case when label not in ('heading', 'paragraph', 'list', 'math', 'caption', 'table', 'figure', 'other', 'code', 'title', 'author', 'date') then 'label is unknown' end from e
  union all select case when level is not null and label <> 'heading' then 'level without a heading' end from e union all select case when label = 'heading' and level not between 1 and 3 then 'level is out of range' end from e)
select m as problem, count(*) as n from m where m is not null group by m""")
def validation_problems(t: Tables) -> DataFrame:
    from quillframe.operators.validation import element_problems

    e = t.spark.sql(f"select {FAULTY} from {{gt}}", gt=t.gt)
    return e.select(F.explode(element_problems()).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


TEX_LINE = """case label when 'heading' then concat(chr(92), case level when 1 then '' when 2 then 'sub' else 'subsub' end, 'section{', body, '}') when 'list' then concat(chr(92), 'item ', body) when 'math' then concat(chr(92), '[', body, chr(92), ']')
  when 'title' then concat(chr(92), 'title{', body, '}') when 'author' then concat(chr(92), 'author{', body, '}') when 'date' then concat(chr(92), 'date{', body, '}') when 'code' then concat(chr(92), 'texttt{', body, '}') else body end"""
TEX_BODY_SQL = "replace(replace(replace(regexp_replace(replace(replace(replace(text, chr(92), chr(57344)), '~', chr(57345)), '^', chr(57346)), '([%&_#{}$])', '\\\\\\1', 'g'), chr(57344), '\\textbackslash{}'), chr(57345), '\\textasciitilde{}'), chr(57346), '\\textasciicircum{}')"


@query(f", x as (select doc_id, ord, label, level, {TEX_BODY_SQL} as body from gt where label not in ('other', 'table', 'figure')) select doc_id, count(*) as n_blocks, md5(string_agg({TEX_LINE}, chr(10) || chr(10) order by ord)) as tex from x group by doc_id")
def document_to_tex(t: Tables) -> DataFrame:
    return documents.to_tex(t.gt).select("doc_id", "n_blocks", F.md5(F.encode("tex", "UTF-8")).alias("tex"))


@query("""
select doc_id, coalesce(string_agg(text, '' order by ord) filter (where label = 'title'), '') as title, coalesce(string_agg(text, ' ' order by ord) filter (where label = 'author'), '') as author,
  coalesce(string_agg(text, ' ' order by ord) filter (where label = 'date'), '') as date from gt where page = 1 and label in ('title', 'author', 'date') group by doc_id""")
def title_blocks(t: Tables) -> DataFrame:
    return documents.title_blocks(t.gt.where("page = 1"))


@query("""
, a as (select doc_id, min(x0) as a, max(x1) as b from gt where kind = 'text' and label <> 'other' group by doc_id)
select doc_id, ord, round(greatest(0.05, least(1, (x1 - x0) / nullif(b - a, 0))), 3) as width from gt left join a using (doc_id) where kind = 'figure'""")
def image_widths(t: Tables) -> DataFrame:
    return documents.image_widths(t.gt)


@query("""
, f as (select doc_id, page, ord, x1 - x0 as w, length(text) as n, size2, ord % 40 as place, label from gt),
v as (select doc_id, ord, case when ord % 2 = 0 and n <= 80 and size2 >= 23 then 0.8 else 0.2 end as heading, case when place < 2 then 0.8 else 0 end as other, case when n > 200 then 0.9 else 0.4 end as paragraph from f)
select doc_id, ord, case when greatest(heading, other, paragraph) < 0.5 then 'paragraph' when heading >= other and heading >= paragraph then 'heading' when other >= paragraph then 'other' else 'paragraph' end as label,
  cast(greatest(heading, other, paragraph) as double) as confidence from v""")
def expert_vote(t: Tables) -> DataFrame:
    n = F.length("text")
    experts = {"heading": F.when((F.col("ord") % 2 == 0) & (n <= 80) & (F.col("size2") >= 23), 0.8).otherwise(0.2), "other": F.when(F.col("ord") % 40 < 2, 0.8).otherwise(0.0), "paragraph": F.when(n > 200, 0.9).otherwise(0.4)}
    vote = documents.vote(experts)
    return t.gt.select("doc_id", "ord", vote["label"].alias("label"), vote["confidence"].alias("confidence"))


@query("""
, b as (select doc_id, size2, sum(length(text)) as w, min(ord) as f from gt group by doc_id, size2), body as (select doc_id, size2 as body from (select *, row_number() over (partition by doc_id order by w desc, f) as n from b) where n = 1)
select doc_id, ord, case when kind <> 'text' then kind when regexp_matches(text, '^(図|表|Figure|Fig\\.|Table)\\s*[0-9]+') and length(text) <= 100 then 'caption' when (size2 >= 1.1 * body or bold) and length(text) <= 50 then 'heading' else 'paragraph' end as label
from gt join body using (doc_id)""")
def rule_classifier(t: Tables) -> DataFrame:
    """Kind, then caption, then heading by size against the document's body size, then paragraph."""
    body = layout.weighted_mode(t.gt.withColumn("w0", F.length("text")), ["doc_id"], "size2", "w0").withColumnRenamed("size2", "body")
    return documents.classify(t.gt.join(body, "doc_id"), size_ratio=1.1).select("doc_id", "ord", F.col("rule").alias("label"))
