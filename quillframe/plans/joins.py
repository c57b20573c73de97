"""Joins of boxes, points and intervals of a page, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.operators import matching
from quillframe.plans.tables import BOTH, PAGE, Tables, query


@query(f"""
, x as (select doc_id, page, p.ord, g.label, g.ord as g, cast({BOTH} as double) / ((p.x1 - p.x0) * (p.y1 - p.y0)) as ratio from pred p join gt g using (doc_id, page)),
best as (select *, row_number() over (partition by doc_id, page, ord order by ratio desc, g) as n from x where ratio >= 0.5)
select doc_id, cast(page as bigint) as page, p.ord, b.label from pred p left join (select * from best where n = 1) b using (doc_id, page, ord)""")
def best_overlap_label(t: Tables) -> DataFrame:
    return matching.best_overlap(t.pred, t.gt, PAGE, "label")


@query("""
, q as (select doc_id, page, ord, (x0 + x1) / 2.0 as x, (y0 + y1) / 2.0 as y from gt), b as (select doc_id, page, ord, x0, x1 + ord % 5 as x1, y0 - 30 as y0, y1 + 30 as y1 from gt where ord % 3 = 0),
x as (select doc_id, page, q.ord, b.ord as container, row_number() over (partition by doc_id, page, q.ord order by (b.x1 - b.x0) * (b.y1 - b.y0), b.ord) as n from q join b using (doc_id, page) where x between b.x0 and b.x1 and y between b.y0 and b.y1)
select doc_id, cast(page as bigint) as page, q.ord, container from q left join (select * from x where n = 1) using (doc_id, page, ord)""")
def smallest_container_assign(t: Tables) -> DataFrame:
    points = t.gt.selectExpr(*PAGE, "ord", "(x0 + x1) / 2.0 as x", "(y0 + y1) / 2.0 as y")
    boxes = t.gt.where("ord % 3 = 0").selectExpr(*PAGE, "ord", "x0", "x1 + ord % 5 as x1", "y0 - 30 as y0", "y1 + 30 as y1")
    return matching.smallest_container(points, boxes, PAGE)


@query("""
, x as (select doc_id, page, p.ord, g.ord as interval, greatest(0, g.y0 - 12 - p.y0, p.y0 - (g.y1 + 5)) as d, g.y1 + 5 - (g.y0 - 12) as h from pred p join (select * from gt where ord % 3 = 1) g using (doc_id, page)),
best as (select *, row_number() over (partition by doc_id, page, ord order by d, h, interval) as n from x where d < 10)
select doc_id, cast(page as bigint) as page, p.ord, b.interval from pred p left join (select * from best where n = 1) b using (doc_id, page, ord)""")
def nearest_interval_assign(t: Tables) -> DataFrame:
    points = t.pred.selectExpr(*PAGE, "ord", "y0 as y")
    return matching.nearest_interval(points, t.gt.where("ord % 3 = 1").selectExpr(*PAGE, "ord", "y0 as top", "y1 as bottom"), PAGE, 12, 5, 10)


@query("""
, p as (select * from gt where kind = 'text'), g as (select doc_id, page, x0, x1, y0 - 12 as y0, y1 + 12 as y1 from gt where kind <> 'text')
select doc_id, cast(page as bigint) as page, ord from p where not exists (select 1 from g where g.doc_id = p.doc_id and g.page = p.page
  and cast(greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0)) as double) / ((p.x1 - p.x0) * (p.y1 - p.y0)) >= 0.3)""")
def absorb_antijoin(t: Tables) -> DataFrame:
    regions = t.gt.where("kind <> 'text'").selectExpr(*PAGE, "x0", "x1", "y0 - 12 as y0", "y1 + 12 as y1")
    return matching.absorb(t.gt.where("kind = 'text'"), regions, PAGE, 0.3).select(*PAGE, "ord")


@query("select doc_id, cast(page as bigint) as page, ord from gt x where not exists (select 1 from gt h where h.doc_id = x.doc_id and h.page = x.page and h.ord % 40 in (0, 39) and h.y0 = x.y0)")
def reserved_glyph_antijoin(t: Tables) -> DataFrame:
    claimed = t.gt.where("ord % 40 in (0, 39)").select(*PAGE, "y0")
    return t.gt.join(claimed, [*PAGE, "y0"], "left_anti").select(*PAGE, "ord")


@query("select setting, case_id from (select distinct setting from grid), (select distinct case_id from grid) where (setting, case_id) not in (select setting, case_id from grid where errors % 2 = 0)")
def cache_missing_antijoin(t: Tables) -> DataFrame:
    """What must still be run: every setting, of which there are a handful, for every case, without what is cached."""
    settings = t.grid.groupBy().agg(F.collect_set("setting").alias("settings"))
    wanted = t.grid.select("case_id").distinct().join(F.broadcast(settings)).select(F.explode("settings").alias("setting"), "case_id")
    return wanted.join(t.grid.where("errors % 2 = 0"), ["setting", "case_id"], "left_anti")


@query(", f as (select ord % 2 as display, text, min(doc_id * 1000000 + ord) as first from lines group by ord % 2, text) select display, md5(text) as formula, first from f")
def formula_dedup(t: Tables) -> DataFrame:
    """The first formula of each (display, text)."""
    return t.lines.groupBy((F.col("ord") % 2).alias("display"), "text").agg(F.min(F.col("doc_id") * 1000000 + F.col("ord")).alias("first")).select("display", F.md5(F.encode("text", "UTF-8")).alias("formula"), "first")


WORDS_SQL = ", w as (select doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) as w from documents), words as (select doc_id, w from w where w <> '')"


def words(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", F.explode(F.split("text", "[^A-Za-z]+", -1)).alias("w")).where("w <> ''")


@query(WORDS_SQL + " select w, count(*) as n from words group by w having count(*) >= 5")
def vocab_mincount(t: Tables) -> DataFrame:
    return words(t).groupBy("w").agg(F.count("*").alias("n")).where("n >= 5")


@query(WORDS_SQL + " select w, count(*) as n from words where doc_id % 5 = 0 and w not in (select w from words where doc_id % 5 <> 0) group by w")
def unknown_tokens(t: Tables) -> DataFrame:
    """Words of the validation fold that the training fold lacks."""
    w = words(t)
    seen = w.where("doc_id % 5 <> 0").select("w").distinct()
    return w.where("doc_id % 5 = 0").groupBy("w").agg(F.count("*").alias("n")).join(seen, "w", "left_anti")


@query("select doc_id from documents a where doc_id % 5 = 0 and not exists (select 1 from documents b where b.doc_id % 5 <> 0 and b.text = a.text)")
def train_val_except(t: Tables) -> DataFrame:
    """Validation documents whose text isn't in the training fold; texts meet by their digests."""
    d = t.table("documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("k"))
    return d.where("doc_id % 5 = 0").join(d.where("doc_id % 5 <> 0").select("k").distinct(), "k", "left_anti").select("doc_id")


@query("""
, l as (select doc_id, list_distinct(string_split(text, ' ')) as a, lead(text) over (partition by doc_id order by ord) as nxt, ord from lines)
select doc_id, ord, len(list_intersect(a, list_distinct(string_split(nxt, ' ')))) as n_common from l where nxt is not null""")
def common_marks(t: Tables) -> DataFrame:
    """What two lines that follow one another have in common."""
    from pyspark.sql import Window

    l = t.lines.withColumn("nxt", F.lead("text").over(Window.partitionBy("doc_id").orderBy("ord"))).where("nxt is not null")
    return l.select("doc_id", "ord", F.size(F.array_intersect(F.split("text", " ", -1), F.split("nxt", " ", -1))).alias("n_common"))
