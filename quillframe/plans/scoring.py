"""Scores of predicted elements against true ones: additive counts, ratios at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.geometry import ratio, ratio_or_zero
from quillframe.functions.tables import same_places, widths_right
from quillframe.functions.text import LABELS, ascii_part, char_errors, edit_distance, indent_width, normalize_text, token_errors
from quillframe.operators import matching
from quillframe.plans.tables import PAGE, Tables, query

ROUND = 6


def r6(c: Column, name: str) -> Column:
    return F.round(c, ROUND).alias(name)


def pages(t: Tables, *columns: str) -> DataFrame:
    """Pages that have true elements, with both sides' elements and pairs."""
    return matching.matched_pages(t.pred, t.gt, PAGE, ["lang", "source", *columns]).where(F.size("gs") > 0)


def pairs(t: Tables, *columns: str) -> DataFrame:
    """Matched pairs with both sides' columns (g_, p_), by default label, level and text."""
    columns = columns or ("label", "level", "text")
    x = pages(t, *columns).select(*PAGE, F.explode("pairs").alias("t"))
    return x.select(*PAGE, "t.i", "t.j", "t.iou", "t.g.lang", "t.g.source", *(F.col(f"t.{side}.{c}").alias(f"{side}_{c}") for side in "gp" for c in columns))


def facts(t: Tables) -> DataFrame:
    """One row for each page with true elements, to be summed by any slice. Predictions on other pages don't count."""
    ok = F.filter("pairs", lambda x: x["g"]["label"] == x["p"]["label"])
    total = F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["iou"])
    counts = {"n_gt": F.size("gs"), "n_pred": F.size("ps"), "n_pairs": F.size("pairs"), "label_ok": F.size(ok), "iou_sum": total}
    return pages(t, "label").select("doc_id", F.col("gs")[0]["lang"].alias("lang"), F.col("gs")[0]["source"].alias("source"), *(c.alias(n) for n, c in counts.items()))


COUNTS = ("n_gt", "n_pred", "n_pairs", "label_ok", "iou_sum")


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


SUMMED_SQL = """
facts as (select doc_id, lang, source, 1 as n_gt, 0 as n_pred, 0 as n_pairs, 0 as label_ok, 0.0::double as iou_sum from gt union all select doc_id, lang, source, 0, 1, 0, 0, 0.0 from pred
  union all select doc_id, lang, source, 0, 0, 1, case when g_label = p_label then 1 else 0 end, iou from pairs)
"""
RATIOS_SQL = """cast(sum(n_gt) as bigint) as n_gt, cast(sum(n_pred) as bigint) as n_pred, cast(sum(n_pairs) as bigint) as n_pairs,
  round(coalesce(sum(n_pairs) / nullif(sum(n_pred), 0), 0), 6) as precision, round(coalesce(sum(n_pairs) / nullif(sum(n_gt), 0), 0), 6) as recall,
  round(coalesce(2 * sum(n_pairs) / nullif(sum(n_pred) + sum(n_gt), 0), 0), 6) as f1, round(sum(iou_sum) / nullif(sum(n_pairs), 0), 6) as miou, round(sum(label_ok) / nullif(sum(n_pairs), 0), 6) as label_acc"""


def ratios() -> list[Column]:
    c = F.col
    return [c("n_gt"), c("n_pred"), c("n_pairs"), r6(ratio_or_zero(c("n_pairs"), c("n_pred")), "precision"), r6(ratio_or_zero(c("n_pairs"), c("n_gt")), "recall"), r6(ratio_or_zero(2 * c("n_pairs"), c("n_pred") + c("n_gt")), "f1"), r6(ratio(c("iou_sum"), c("n_pairs")), "miou"), r6(ratio(c("label_ok"), c("n_pairs")), "label_acc")]


@query(f", {SUMMED_SQL} select 'lang=' || lang as tag, {RATIOS_SQL} from facts group by lang")
def detection_scores_by_tag(t: Tables) -> DataFrame:
    return facts(t).groupBy("lang").agg(*sums()).select(F.concat(F.lit("lang="), "lang").alias("tag"), *ratios())


@query(f", {SUMMED_SQL} select lang, source, {RATIOS_SQL} from facts group by grouping sets ((lang), (source), ())")
def grouped_scores_grouping_sets(t: Tables) -> DataFrame:
    all_sums = ", ".join(f"sum({c}) as {c}" for c in COUNTS)
    return t.spark.sql(f"select lang, source, {all_sums} from {{f}} group by grouping sets ((lang), (source), ())", f=facts(t)).select("lang", "source", *ratios())


@query("select doc_id, cast(page as bigint) as page, i, j, round(iou, 6) as iou from cand")
def iou_pairs(t: Tables) -> DataFrame:
    c = matching.candidate_pairs(t.pred, t.gt, PAGE)
    return c.select(*PAGE, F.col("p_ord").alias("i"), F.col("g_ord").alias("j"), r6(F.col("iou"), "iou"))


@query("select doc_id, cast(page as bigint) as page, i, j, round(iou, 6) as iou from matched")
def greedy_iou_match(t: Tables) -> DataFrame:
    return matching.match(t.pred, t.gt, PAGE).select(*PAGE, "i", "j", r6(F.col("iou"), "iou"))


@query("select x.label, " + ", ".join(f"count(*) filter (where p_label = '{x}') as \"{x}\"" for x in LABELS) + f" from (select unnest({list(LABELS)}) as label) x left join pairs on g_label = x.label group by x.label")
def confusion_matrix(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame([(x,) for x in LABELS], "label string")
    counted = pairs(t, "label").groupBy(F.col("g_label").alias("label")).pivot("p_label", list(LABELS)).count()
    return F.broadcast(dim).join(counted, "label", "left").na.fill(0)


@query("""
, n as (select label, sum(a) as n_gt, sum(b) as n_pred, sum(f) as n_found, sum(k) as n_right from (select label, 1 as a, 0 as b, 0 as f, 0 as k from gt union all select label, 0, 1, 0, 0 from pred where (doc_id, page) in (select doc_id, page from gt)
  union all select g_label, 0, 0, 1, case when g_label = p_label then 1 else 0 end from pairs) group by label),
s as (select label, n_gt, n_pred, n_found / nullif(n_gt, 0) as found_rate, n_right / nullif(n_gt, 0) as recall, n_right / nullif(n_pred, 0) as precision from n)
select label, cast(n_gt as bigint) as n_gt, cast(n_pred as bigint) as n_pred, round(found_rate, 6) as found_rate, round(recall, 6) as recall, round(precision, 6) as precision,
  round(case when recall is null then null when precision is null or precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from s""")
def label_scores(t: Tables) -> DataFrame:
    one = lambda e, a, b, f, k: F.struct(e["label"].alias("label"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f).alias("f"), k.alias("k"))
    none = F.lit(0)
    each = F.concat(F.transform("gs", lambda e: one(e, 1, 0, 0, none)), F.transform("ps", lambda e: one(e, 0, 1, 0, none)), F.transform("pairs", lambda x: one(x["g"], 0, 0, 1, (x["g"]["label"] == x["p"]["label"]).cast("int"))))
    rows = pages(t, "label").select(F.explode(each).alias("e")).select("e.*")
    n = rows.groupBy("label").agg(*(F.sum(x).alias(x) for x in "abfk"))
    c = F.col
    s = n.select("label", c("a").alias("n_gt"), c("b").alias("n_pred"), ratio(c("f"), c("a")).alias("found_rate"), ratio(c("k"), c("a")).alias("recall"), ratio(c("k"), c("b")).alias("precision"))
    both = c("precision") + c("recall")
    f1 = F.when(c("recall").isNull(), None).otherwise(F.coalesce(F.try_divide(2 * c("precision") * c("recall"), both), F.lit(0.0)))
    return s.select("label", "n_gt", "n_pred", *(r6(c(x), x) for x in ("found_rate", "recall", "precision")), r6(f1, "f1"))


@query("select lang, count(*) as n, count(*) filter (where g_level = p_level) as n_right, round(count(*) filter (where g_level = p_level) / count(*), 6) as level_acc from pairs where g_label = 'heading' and p_label = 'heading' group by lang")
def level_accuracy(t: Tables) -> DataFrame:
    n = pairs(t, "label", "level").where("g_label = 'heading' and p_label = 'heading'").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("g_level") == F.col("p_level")).alias("n_right"))
    return n.select("lang", "n", "n_right", r6(ratio(F.col("n_right"), F.col("n")), "level_acc"))


@query("""
, x as (select doc_id, page, lang, j as g, (i * 7) % 23 as p from pairs)
select a.lang, count(*) filter (where (a.p - b.p) * (a.g - b.g) > 0) as concordant, count(*) filter (where (a.p - b.p) * (a.g - b.g) <= 0) as discordant from x a join x b on a.doc_id = b.doc_id and a.page = b.page and a.g < b.g group by a.lang""")
def order_concordance(t: Tables) -> DataFrame:
    """All pairs of a page's matched elements, as the measure is defined on them; a page has at most its own elements."""
    x = pairs(t, "label").select(*PAGE, "lang", F.col("j").alias("g"), ((F.col("i") * 7) % 23).alias("p"))
    b = x.select(*PAGE, F.col("g").alias("g2"), F.col("p").alias("p2"))
    sign = (F.col("p") - F.col("p2")) * (F.col("g") - F.col("g2"))
    return x.join(b, PAGE).where("g < g2").groupBy("lang").agg(F.count_if(sign > 0).alias("concordant"), F.count_if(sign <= 0).alias("discordant"))


@query("""
, k as (select unnest(['heading', 'paragraph', 'list', 'math', 'caption', 'table', 'figure', 'other', 'code', 'title', 'author', 'date']) as label),
n as (select label, count(*) filter (where g_label = label) as support, count(*) filter (where p_label = label) as n_pred, count(*) filter (where g_label = label and p_label = label) as tp from k, pairs group by label),
s as (select support, tp / greatest(n_pred, 1) as p, tp / greatest(support, 1) as r from n where support > 0)
select count(*) as n_labels, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 6) as macro_f1 from s""")
def macro_f1(t: Tables) -> DataFrame:
    by = pairs(t, "label").select(F.explode(F.array(F.struct(F.col("g_label").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("n"), (F.col("g_label") == F.col("p_label")).cast("int").alias("tp")), F.struct(F.col("p_label").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("n"), F.lit(0).alias("tp")))).alias("side")).select("side.*")
    n = by.groupBy("label").agg(*(F.sum(x).alias(x) for x in ("s", "n", "tp"))).where("s > 0")
    p, r = F.col("tp") / F.greatest("n", F.lit(1)), F.col("tp") / F.greatest("s", F.lit(1))
    return n.select(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")).agg(F.count("*").alias("n_labels"), r6(F.avg("f1"), "macro_f1"))


@query("""
, b as (select case when n_chars >= 600 then 1 else 0 end as p, quality as y from documents join labels using (doc_id) where quality is not null and n_chars is not null),
n as (select count(*) as n, sum(case when p = y then 1 else 0 end) as ok, sum(p * y) as tp, sum(p) as np, sum(y) as ny from b)
select n, round(ok / n, 6) as accuracy, round(coalesce(tp / nullif(np, 0), 0), 6) as precision, round(coalesce(tp / nullif(ny, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(np + ny, 0), 0), 6) as f1 from n""")
def binary_scores(t: Tables) -> DataFrame:
    b = t.table("documents").select("doc_id", "n_chars").join(t.table("labels").select("doc_id", "quality"), "doc_id").where("quality is not null and n_chars is not null")
    p = (F.col("n_chars") >= 600).cast("int")
    n = b.select(p.alias("p"), F.col("quality").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("y")).alias("ok"), F.sum(F.col("p") * F.col("y")).alias("tp"), F.sum("p").alias("np"), F.sum("y").alias("ny"))
    c = F.col
    return n.select("n", r6(ratio(c("ok"), c("n")), "accuracy"), r6(ratio_or_zero(c("tp"), c("np")), "precision"), r6(ratio_or_zero(c("tp"), c("ny")), "recall"), r6(ratio_or_zero(2 * c("tp"), c("np") + c("ny")), "f1"))


INDENTED = "concat(repeat(' ', cast(ord % 5 as int)), text) as g_text, concat(repeat(' ', cast(case when ord % 9 = 4 then 0 else ord % 5 end as int)), text) as p_text"


@query(f", x as (select lang, {INDENTED} from lines) select lang, count(*) as n, count(*) filter (where length(g_text) - length(ltrim(g_text)) = length(p_text) - length(ltrim(p_text))) as n_right from x group by lang")
def indent_accuracy(t: Tables) -> DataFrame:
    x = t.lines.selectExpr("lang", *INDENTED.replace(", concat", "\nconcat").split("\n"))
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(indent_width(F.col("g_text")) == indent_width(F.col("p_text"))).alias("n_right"))


@query("""
select count(distinct t) as n_tables, 3 * count(*) as n_cells, cast(sum(case when found then (a = pa)::int + (b = pb)::int + (c = pc)::int else 0 end) as bigint) as n_right,
  (select count(*) from (select t from table_rows group by t having count(*) = count(*) filter (where found))) as same_shape from table_rows""")
def table_cell_accuracy(t: Tables) -> DataFrame:
    """Cells compared by place; one that is missing is wrong. Rows of a table meet by a partial aggregate, not by a join."""
    x = t.table_rows.select("t", "found", F.array("a", "b", "c").alias("g"), F.when(F.col("found"), F.array("pa", "pb", "pc")).alias("p"))
    per = x.groupBy("t").agg(F.sum(F.size("g")).alias("n"), F.sum(same_places(F.col("g"), F.col("p"))).alias("ok"), F.bool_and("found").cast("int").alias("same"))
    return per.agg(F.count("*").alias("n_tables"), F.sum("n").alias("n_cells"), F.sum("ok").alias("n_right"), F.sum("same").alias("same_shape"))


ALIGNS = "case o_orderkey % 3 when 0 then 'lcr' when 1 then 'rrl' else 'ccc' end as g, case when o_orderkey % 4 = 0 then 'lcl' else case o_orderkey % 3 when 0 then 'lcr' when 1 then 'rrl' else 'ccc' end end as p"


@query(f", x as (select {ALIGNS} from orders) select 3 * count(*) as n, cast(sum((g[1] = p[1])::int + (g[2] = p[2])::int + (g[3] = p[3])::int) as bigint) as n_right from x")
def table_align_accuracy(t: Tables) -> DataFrame:
    x = t.table("orders").selectExpr(*ALIGNS.replace(", case when", "\ncase when").split("\n")).select(F.split("g", "").alias("g"), F.split("p", "").alias("p"))
    return x.agg(F.sum(F.size("g")).alias("n"), F.sum(same_places(F.col("g"), F.col("p"))).alias("n_right"))


@query("""
, w as (select o_orderkey % 100 as a, o_orderkey % 7 as b from orders)
select cast(sum(1 + case when b <> 0 then 1 else 0 end) as bigint) as n, cast(sum(case when b <= 3 then 1 else 0 end + case when b in (1, 2, 3) then 1 else 0 end) as bigint) as n_right from w""")
def column_width_accuracy(t: Tables) -> DataFrame:
    """Widths in hundredths: the second column has none where o_orderkey is a multiple of 7; predictions are b hundredths off."""
    o = t.table("orders").select((F.col("o_orderkey") % 100).alias("a"), (F.col("o_orderkey") % 7).alias("b"))
    none = F.lit(None).cast("long")
    g = F.array(F.col("a"), F.when(F.col("b") != 0, F.col("a") + 5), none)
    p = F.array(F.col("a") + F.col("b"), F.when(F.col("b") != 0, F.col("a") + 5 + F.col("b")), none)
    n, right = widths_right(g, p, 3)
    return o.agg(F.sum(n).alias("n"), F.sum(right).alias("n_right"))


@query()
def micro_cer_by_lang(t: Tables) -> DataFrame:
    """Errors summed, then divided; tables don't count. SQL engines differ in what a character is; tests compare with a plain loop."""
    x = pairs(t, "label", "text").where("g_label <> 'table'")
    e = char_errors(F.col("g_text"), F.col("p_text"))
    n = x.groupBy("lang").agg(F.sum(e["errors"]).alias("errors"), F.sum(e["chars"]).alias("chars"))
    return n.select("lang", "errors", "chars", r6(ratio(F.col("errors"), F.col("chars")), "cer"))


@query()
def token_error_rate(t: Tables) -> DataFrame:
    """Edit distance over TeX tokens of matched formulas; tests compare with a plain loop."""
    e = token_errors(F.col("g_text"), F.col("p_text"))
    n = pairs(t, "label", "text").where("g_label = 'math'").groupBy("lang").agg(F.sum(e["errors"]).alias("errors"), F.sum(e["tokens"]).alias("tokens"), F.avg((normalize_text(F.col("g_text")) == normalize_text(F.col("p_text"))).cast("int")).alias("exact"))
    return n.select("lang", "errors", "tokens", r6(ratio(F.col("errors"), F.col("tokens")), "ter"), r6(F.col("exact"), "exact"))


PLAIN_SQL = "regexp_replace(coalesce({0}, ''), '[^\\x21-\\x7E]', '', 'g')"


@query(f"""
, n as (select lang, count(*) as n_gt from gt group by lang), m as (select lang, count(*) as n_pred from pred where (doc_id, page) in (select doc_id, page from gt) group by lang),
o as (select a.lang, count(*) filter (where (a.i - b.i) * (a.j - b.j) > 0) as c, count(*) as k from pairs a join pairs b on a.doc_id = b.doc_id and a.page = b.page and a.j < b.j group by a.lang),
x as (select *, {PLAIN_SQL.format("g_text")} as g, {PLAIN_SQL.format("p_text")} as p from pairs),
e as (select lang, count(*) as n_pairs, sum(iou) as iou, count(*) filter (where g_label = p_label) as ok, count(*) filter (where g_label = 'heading' and p_label = 'heading' and g_level = p_level) as lv, count(*) filter (where g_label = 'heading' and p_label = 'heading' and g_level is not null and p_level is not null) as ln,
  sum(levenshtein(g, p)) filter (where g_label <> 'table') as err, sum(length(g)) filter (where g_label <> 'table') as ch from x group by lang)
select lang, round(n_pairs / n_pred, 6) as precision, round(n_pairs / n_gt, 6) as recall, round(2 * n_pairs / (n_pred + n_gt), 6) as f1, round(iou / n_pairs, 6) as miou, round(ok / n_pairs, 6) as label_acc, round(lv / nullif(ln, 0), 6) as level_acc,
  round(c / nullif(k, 0), 6) as order_acc, round(err / nullif(ch, 0), 6) as cer_en from e join n using (lang) join m using (lang) left join o using (lang)""")
def summary_by_lang(t: Tables) -> DataFrame:
    """One row of ratios for each slice, from counts that are summed page by page; null where nothing could be counted."""
    size = lambda keep: F.size(F.filter("pairs", keep))
    heading = lambda x: (x["g"]["label"] == "heading") & (x["p"]["label"] == "heading")
    total = lambda of: F.aggregate("pairs", F.lit(0).cast("long"), lambda a, x: a + of(x).cast("long"))
    plain = lambda c: ascii_part(normalize_text(F.coalesce(c, F.lit(""))))
    seen = lambda x, n: F.when(x["g"]["label"] == "table", 0).otherwise(n)
    alike = total(lambda x: F.size(F.filter("pairs", lambda y: (x["i"] - y["i"]) * (x["j"] - y["j"]) > 0)))
    counts = {
        "n_gt": F.size("gs"), "n_pred": F.size("ps"), "n_pairs": F.size("pairs"), "iou": F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["iou"]),
        "ok": size(lambda x: x["g"]["label"] == x["p"]["label"]), "level_ok": size(lambda x: heading(x) & (x["g"]["level"] == x["p"]["level"])), "level_n": size(lambda x: heading(x) & x["g"]["level"].isNotNull() & x["p"]["level"].isNotNull()),
        # Each pair of pairs is met from both sides.
        "alike": alike / 2, "order_n": F.size("pairs") * (F.size("pairs") - 1) / 2,
        "errors": total(lambda x: seen(x, edit_distance(plain(x["g"]["text"]), plain(x["p"]["text"])))), "chars": total(lambda x: seen(x, F.length(plain(x["g"]["text"])))),
    }
    n = pages(t, "label", "level", "text").select(F.col("gs")[0]["lang"].alias("lang"), *(c.alias(k) for k, c in counts.items())).groupBy("lang").agg(*(F.sum(k).alias(k) for k in counts))
    c = F.col
    shares = {"precision": ratio_or_zero(c("n_pairs"), c("n_pred")), "recall": ratio_or_zero(c("n_pairs"), c("n_gt")), "f1": ratio_or_zero(2 * c("n_pairs"), c("n_pred") + c("n_gt")), "miou": ratio(c("iou"), c("n_pairs")), "label_acc": ratio(c("ok"), c("n_pairs")), "level_acc": ratio(c("level_ok"), c("level_n")), "order_acc": ratio(c("alike"), c("order_n")), "cer_en": ratio(c("errors"), c("chars"))}
    return n.select("lang", *(r6(v, k) for k, v in shares.items()))
