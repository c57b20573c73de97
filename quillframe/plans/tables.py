"""Tables that queries run on: page elements, derived from the lines of documents by arithmetic that any SQL engine repeats."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quillframe.functions.text import LABELS

PAGE = ["doc_id", "page"]


def case_of(number: str, values: tuple[str, ...]) -> str:
    return f"case {number} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


#: Views that Spark and other engines read alike; {name} is another view.
GT = f"""
select *, case when label in ('table', 'figure') then label else 'text' end as kind, case when label = 'heading' then 1 + ord % 3 end as level
from (select doc_id, lang, source, ord, cast(floor(ord / 40) as int) + 1 as page, 100 as x0, 100 + 8 * least(length(text), 100) as x1, (ord % 40) * 24 as y0, (ord % 40) * 24 + 20 as y1, text,
  {case_of("(doc_id * 7 + ord * 5) % 12", LABELS)} as label, 20 + (doc_id + ord) % 4 as size2, (doc_id + ord) % 3 = 0 as bold from {{lines}}) as x
"""
PRED = """
select doc_id, lang, source, page, ord * 2 as ord, x0 + 6 * ((doc_id * 7 + ord) % 5) as x0, x1 + 6 * ((doc_id * 7 + ord) % 5) as x1, y0 + 5 * ((doc_id + ord) % 3) as y0, y1 + 5 * ((doc_id + ord) % 3) as y1,
  case when ord % 13 = 5 then 'other' else label end as label, case when ord % 7 = 3 then substr(text, 2) else text end as text, case when ord % 19 = 7 then 1 else level end as level from {gt} where ord % 11 <> 10
union all
select doc_id, lang, source, page, ord * 2 + 1, x0 + 2, x1 + 2, y0 + 1, y1 + 1, 'paragraph', text, level from {gt} where ord % 17 = 3
"""
COLUMNS = "select *, case when ord % 7 = 0 then 0 when ord % 2 = 0 then 1 else 2 end as col, cast(floor((ord % 40) / 2) as int) * 24 as top from {gt}"
MARKED = """
select doc_id, lang, ord, case ord % 8 when 0 then concat(cast(ord % 9 + 1 as varchar(9)), '.', cast(doc_id % 4 + 1 as varchar(9)), ' ', text) when 1 then concat('(', cast(ord % 9 + 1 as varchar(9)), ') ', text)
  when 2 then concat('Figure ', cast(ord + 1 as varchar(9)), ': ', text) when 3 then concat('- ', text) when 4 then concat('• ', text) when 5 then concat(cast(ord % 9 + 1 as varchar(9)), '. ', text)
  when 6 then concat(cast(ord % 9 + 1 as varchar(9)), ' ', text) else
    case floor(ord / 8) % 6 when 0 then concat('１\u3000', text) when 1 then concat('１．２ ', text) when 2 then concat('（１２）', text) when 3 then concat('図１：', text) when 4 then concat('１２．', text) else concat('表\u3000３-１\u3000', text) end end as text from {lines}
"""
TABLE_ROWS = """
select l_orderkey as t, l_linenumber as r, cast(l_partkey as varchar(20)) as a, cast(l_suppkey as varchar(20)) as b, concat(l_returnflag, l_linestatus) as c,
  case when (l_orderkey + l_linenumber) % 9 = 0 then 'x' else cast(l_partkey as varchar(20)) end as pa, cast(l_suppkey as varchar(20)) as pb, case when (l_orderkey + l_linenumber) % 7 = 0 then '' else concat(l_returnflag, l_linestatus) end as pc,
  not (l_orderkey % 10 = 0 and l_linenumber = 1) as found from {lineitem}
"""
RUNS = "select event_id as run_id, event_type as model, concat('d', cast(user_id % 3 as varchar(9))) as dataset, value, cast(user_id % 50 as int) as pages from {events}"
GRID = "select event_type as setting, user_id as case_id, sum(cast(floor(value) as bigint)) as errors, sum(100 + user_id % 50) as chars from {events} group by event_type, user_id"
SHARED = {"gt": GT, "pred": PRED, "columns": COLUMNS, "marked": MARKED, "table_rows": TABLE_ROWS, "runs": RUNS, "grid": GRID}

LINES_SQL = """select doc_id, lang, source, ord, text from (select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source, unnest(range(len(p))) as ord, unnest(p) as text
  from (select doc_id, lang, source, string_split(text, chr(10)) as p from documents)) where text <> ''"""
BOTH = "greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0))"
MATCHED_SQL = f"""
crossed as (select doc_id, page, p.ord as i, g.ord as j, {BOTH} as both_area, (p.x1 - p.x0) * (p.y1 - p.y0) as pa, (g.x1 - g.x0) * (g.y1 - g.y0) as ga from pred p join gt g using (doc_id, page)),
cand as (select doc_id, page, i, j, cast(both_area as double) / (pa + ga - both_area) as iou from crossed where both_area > 0 and cast(both_area as double) / (pa + ga - both_area) >= 0.5),
ranked as (select *, row_number() over (partition by doc_id, page order by iou desc, i desc, j desc) as r from cand),
steps as (select doc_id, page, r, i, j, iou, true as taken, [i] as us, [j] as vs from ranked where r = 1
  union all select c.doc_id, c.page, c.r, c.i, c.j, c.iou, not (list_contains(us, c.i) or list_contains(vs, c.j)), case when list_contains(us, c.i) or list_contains(vs, c.j) then us else list_append(us, c.i) end,
    case when list_contains(us, c.i) or list_contains(vs, c.j) then vs else list_append(vs, c.j) end from steps s join ranked c on c.doc_id = s.doc_id and c.page = s.page and c.r = s.r + 1),
matched as (select doc_id, page, i, j, iou from steps where taken),
pairs as (select m.doc_id, m.page, i, j, iou, g.lang, g.source, g.label as g_label, p.label as p_label, g.level as g_level, p.level as p_level, g.text as g_text, p.text as p_text
  from matched m join gt g on g.doc_id = m.doc_id and g.page = m.page and g.ord = m.j join pred p on p.doc_id = m.doc_id and p.page = m.page and p.ord = m.i)
"""


def with_views(sql: str) -> str:
    """A query's SQL after the views."""
    names = {k: k for k in SHARED} | {"lines": "lines", "lineitem": "lineitem", "events": "events"}
    views = ", ".join(f"{k} as ({v.format(**names)})" for k, v in SHARED.items())
    return f"with recursive lines as ({LINES_SQL}), {views}, {MATCHED_SQL} {sql}"


class Tables:
    """The driver's tables and the views, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        d = self.table("documents")
        return d.selectExpr("doc_id", "coalesce(lang, 'none') as lang", "coalesce(source, 'none') as source", "posexplode(split(text, '\\n', -1)) as (ord, text)").where("text <> ''")

    def view(self, name: str, **of: DataFrame) -> DataFrame:
        return self.view_of(SHARED[name], **of)

    def view_of(self, sql: str, **of: DataFrame) -> DataFrame:
        return self.spark.sql(sql, **of)

    @cached_property
    def gt(self) -> DataFrame:
        return self.view("gt", lines=self.lines)

    @cached_property
    def pred(self) -> DataFrame:
        return self.view("pred", gt=self.gt)

    @cached_property
    def columns(self) -> DataFrame:
        return self.view("columns", gt=self.gt)

    @cached_property
    def marked(self) -> DataFrame:
        return self.view("marked", lines=self.lines)

    @cached_property
    def table_rows(self) -> DataFrame:
        return self.view("table_rows", lineitem=self.table("lineitem"))

    @cached_property
    def runs(self) -> DataFrame:
        return self.view("runs", events=self.table("events"))

    @cached_property
    def grid(self) -> DataFrame:
        return self.view("grid", events=self.table("events"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def longs(df: DataFrame) -> DataFrame:
    """df with 64-bit integers only."""
    return df.select(*(df[c].cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else df[c] for c, kind in df.dtypes))


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its name; sql is for other engines and reads the views."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: longs(f(Tables(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return put
