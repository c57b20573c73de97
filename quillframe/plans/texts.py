"""Text, list-marker, link and TeX functions over whole documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as fn
from quillframe.plans.layouts import TEX_BODY_SQL
from quillframe.plans.tables import Tables, query

SPACES = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
SEEN = f"regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g')"


def digest(c):  # noqa: ANN001, ANN201
    return F.md5(F.encode(c, "UTF-8"))


@query(f"select doc_id, length({SEEN}) as n_chars, md5({SEEN}) as text from documents")
def whitespace_normalise(t: Tables) -> DataFrame:
    seen = fn.normalize_text(F.coalesce("text", F.lit("")))
    return t.table("documents").select("doc_id", F.length(seen).alias("n_chars"), digest(seen).alias("text"))


@query(f"select doc_id, length(regexp_replace({SEEN}, '[^\\x00-\\x7F]', '', 'g')) as n_ascii, length(regexp_replace({SEEN}, '[\\x00-\\x7F]', '', 'g')) as n_other from documents")
def script_split_lengths(t: Tables) -> DataFrame:
    seen = fn.normalize_text(F.coalesce("text", F.lit("")))
    return t.table("documents").select("doc_id", F.length(fn.ascii_part(seen)).alias("n_ascii"), F.length(fn.other_part(seen)).alias("n_other"))


@query(f"""
, s as (select doc_id, {SEEN} as s from documents),
n as (select doc_id, length(s) as n, length(s) - length(regexp_replace(s, '[0-9]', '', 'g')) as digits, length(s) - length(regexp_replace(s, '[A-Za-z]', '', 'g')) as letters, length(s) - length(regexp_replace(s, '[\\x{{3000}}-\\x{{10FFFF}}]', '', 'g')) as cjk from s)
select doc_id, digits, letters, cjk, n - digits - letters - cjk as others from n""")
def char_mix(t: Tables) -> DataFrame:
    mix = fn.char_mix(F.coalesce("text", F.lit("")))
    return t.table("documents").select("doc_id", *(c.alias(n) for n, c in mix.items()))


@query(f"""
, s as (select coalesce(lang, 'none') as lang, {SEEN} as s from documents), g as (select lang, case when length(regexp_replace(s, '[\\x00-\\x7F]', '', 'g')) * 10 >= greatest(1, length(s)) * 3 then 'ja' else 'en' end as guess from s)
select lang, guess, count(*) as n from g group by lang, guess""")
def guess_lang(t: Tables) -> DataFrame:
    d = t.table("documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), fn.guess_lang(F.coalesce("text", F.lit(""))).alias("guess"))
    return d.groupBy("lang", "guess").agg(F.count("*").alias("n"))


def replaced_sql(c: str) -> str:
    for code, text in fn.CONTROLS.items():
        c = f"replace({c}, chr({code}), '{text}')"
    return f"regexp_replace({c}, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]', '', 'g')"


CODES = list(fn.CONTROLS)


@query(f"select doc_id, ord, md5(concat(([{', '.join(repr(x) for x in fn.CONTROLS.values())}])[ord % 18 + 1], {replaced_sql('text')}, ([{', '.join(repr(x) for x in fn.CONTROLS.values())}])[ord % 17 + 1])) as text from lines")
def control_char_fix(t: Tables) -> DataFrame:
    """Every line, whatever control characters it has, with one code of the table before it and another, and one that is lost, after it."""
    codes = F.array(*(F.lit(chr(c)) for c in CODES))
    broken = F.concat(F.get(codes, F.col("ord") % 18), "text", F.lit("\x01\x7f\x9f"), F.get(codes, F.col("ord") % 17))
    return t.lines.select("doc_id", "ord", digest(fn.fix_controls(broken)).alias("text"))


#: White space and digits in the other engine's patterns, which know neither (?U) nor looking ahead.
S, D = r"[\s\p{Z}\x0b\x1c-\x1f\x85]", r"\p{Nd}"
COUNTER = "[年月日時分秒章節項回位点人個件円倍]"


@query(f"""
, n as (select doc_id, ord, text, regexp_extract(text, '^({D}{{1,2}}(\\.{D}{{1,2}})*)', 1) as number from marked), r as (select *, substr(text, length(number) + 1) as rest from n),
k as (select *, regexp_extract(rest, '^(\\.?{S}+)', 1) as gap from r),
s as (select doc_id, ord, text, case when number = '' then text when gap <> '' and not regexp_matches(substr(rest, length(gap) + 1), '^{COUNTER}') then substr(rest, length(gap) + 1)
  when gap <> '' and length(gap) - (case when gap[1] = '.' then 1 else 0 end) > 1 then substr(rest, length(gap)) when rest[1] = '.' and regexp_matches(substr(rest, 2), '^[^{D}]') and not regexp_matches(substr(rest, 2), '^{S}') then substr(rest, 2) else text end as s from k)
select doc_id, ord, md5(case when regexp_replace(s, '{S}', '', 'g') = '' then text else s end) as text from s""")
def strip_heading_numbers(t: Tables) -> DataFrame:
    return t.marked.select("doc_id", "ord", digest(fn.strip_heading_number(F.col("text"))).alias("text"))


@query(f"""
, w as (select doc_id, ord, text, case when starts_with(text, '図') or starts_with(text, '表') then 1 when starts_with(text, 'Figure') then 6 when starts_with(text, 'Fig.') then 4 when starts_with(text, 'Table') then 5 else 0 end as n from marked),
r as (select *, regexp_extract(substr(text, n + 1), '^({S}*{D}+([.\\-]{D}+)*)', 1) as number from w), g as (select *, substr(text, n + length(number) + 1) as rest from r),
s as (select doc_id, ord, text, case when n = 0 or number = '' then text else coalesce(nullif(regexp_extract(rest, '^({S}*[:：.．]{S}*)', 1), ''), regexp_extract(rest, '^({S}+)', 1)) end as gap, n, number, rest from g),
f as (select doc_id, ord, text, case when n = 0 or number = '' or gap = '' then text else substr(rest, length(gap) + 1) end as s from s)
select doc_id, ord, md5(case when regexp_replace(s, '{S}', '', 'g') = '' then text else s end) as text from f""")
def strip_caption_numbers(t: Tables) -> DataFrame:
    return t.marked.select("doc_id", "ord", digest(fn.strip_caption_number(F.col("text"))).alias("text"))


@query(f"""
, h as (select lang, text, text[1] as c, regexp_extract(text, '^([(（]?{D}+)', 1) as number, length(text) as n from marked),
k as (select lang, case when number <> '' and c in ('(', '（') and text[length(number) + 1] in (')', '）') then 'paren' when number <> '' and c not in ('(', '（') and text[length(number) + 1] in ('.', '．', ')', '）') then 'number'
  when c = '・' then 'dot' when c in ('•', '●', '◦', '▪', '*') then 'bullet' when c in ('-', '–', '—', '−', '‐') and regexp_matches(text[2], '^{S}') then 'dash' end as marker from h)
select lang, marker, count(*) as n from k group by lang, marker""")
def list_marker_kinds(t: Tables) -> DataFrame:
    return t.marked.select("lang", fn.list_marker(F.col("text")).alias("marker")).groupBy("lang", "marker").agg(F.count("*").alias("n"))


@query(f"select doc_id, ord, least(3, len(string_split(number, '.'))) as level from (select doc_id, ord, regexp_extract(text, '^({D}+(?:\\.{D}+)*)\\.?{S}', 1) as number from marked) where number <> ''")
def heading_number_levels(t: Tables) -> DataFrame:
    return t.marked.select("doc_id", "ord", fn.number_depth(F.col("text")).alias("level")).where("level is not null")


@query("""
, u as (select page_id, case page_id % 5 when 0 then url when 1 then ' ' || url when 2 then replace(url, 'https://', '') when 3 then 'someone@example.org' else 'ftp://example.org/x' end as u from pages), v as (select page_id, trim(u) as u from u)
select page_id, case when u is null or u = '' then null when regexp_matches(u, '(?i)^(https?://|mailto:)') then u when regexp_matches(u, '(?i)^[a-z][a-z0-9+.-]*:') then null when regexp_matches(u, '^[^\\s@/]+@[^\\s@]+$') then 'mailto:' || u else 'https://' || u end as link from v""")
def link_url_normalise(t: Tables) -> DataFrame:
    u = t.table("pages").selectExpr("page_id", "case page_id % 5 when 0 then url when 1 then concat(' ', url) when 2 then replace(url, 'https://', '') when 3 then 'someone@example.org' else 'ftp://example.org/x' end as u")
    return u.select("page_id", fn.link_url(F.col("u")).alias("link"))


@query(f"select doc_id, ord, md5({TEX_BODY_SQL}) as tex from lines")
def tex_escape(t: Tables) -> DataFrame:
    return t.lines.select("doc_id", "ord", digest(fn.tex_escape(F.col("text"))).alias("tex"))


@query(f"""
, t as (select row_number() over () as n, doc_id, coalesce(regexp_extract_all(text, '\\\\[a-zA-Z]+|\\\\.|[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]'), []) as ts from documents), v as (select distinct unnest(ts) as w from t where doc_id % 5 <> 0),
bad as (select distinct n from (select n, unnest(ts) as w from t where len(ts) <= 50) as x where not exists (select 1 from v where v.w = x.w))
select doc_id, len(ts) as n_tokens, len(ts) <= 50 and n not in (select n from bad) as in_scope from t""")
def tex_token_scope(t: Tables) -> DataFrame:
    """At most 50 tokens, all in the vocabulary: the tokens of the training fold."""
    texts = t.table("documents").select("doc_id", "text")
    vocabulary = texts.where("doc_id % 5 <> 0").mapInArrow(tokens_of_batches, "token string").distinct()
    d = texts.mapInArrow(judged_tokens(50), f"doc_id {texts.dtypes[0][1]}, n_tokens int, tokens array<string>")
    unknown = d.where("n_tokens <= 50").select("tokens", F.explode("tokens").alias("token")).join(vocabulary, "token", "left_anti").select("tokens").distinct()
    judged = d.join(unknown.withColumn("unknown", F.lit(True)), "tokens", "left")
    return judged.select("doc_id", "n_tokens", ((F.col("n_tokens") <= 50) & F.col("unknown").isNull()).alias("in_scope"))


def tokens_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each batch's texts, once a batch."""
    for batch in batches:
        known: set[str] = set()
        for text in batch.column("text"):
            known |= fn.tex_token_set(text.as_py() or "")[1]
        yield pa.RecordBatch.from_arrays([pa.array(sorted(known), pa.string())], names=["token"])


def judged_tokens(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's number of tokens; those that differ, in order, of texts that have no more than most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fn.tex_token_set(text.as_py() or "") for text in batch.column("text")]
            counts, tokens = [n for n, _ in found], [sorted(ts) if n <= most else None for n, ts in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "n_tokens", "tokens"])

    return run


@query("select 'lang=' || coalesce(lang, 'none') as tag, count(*) as n from documents group by 1 union all select 'long=' || case when n_chars >= 1000 then 'True' else 'False' end, count(*) from documents where n_chars is not null group by 1")
def tag_counts(t: Tables) -> DataFrame:
    d = t.table("documents")
    tags = F.array(F.struct(F.lit("lang").alias("k"), F.coalesce("lang", F.lit("none")).alias("v")), F.struct(F.lit("long").alias("k"), (F.col("n_chars") >= 1000).cast("string").alias("v")))
    return d.select(F.explode(tags).alias("t")).where("t.v is not null").groupBy(fn.tag_key(F.col("t.k"), F.col("t.v")).alias("tag")).agg(F.count("*").alias("n"))


@query("select doc_id, bool_or(label = 'list') as has_list, bool_or(label = 'title') as has_title, bool_or(label = 'table') as has_table, bool_or(label = 'figure') as has_figure, bool_or(label = 'math') as has_math, bool_or(label = 'code') as has_code from gt group by doc_id")
def case_tags(t: Tables) -> DataFrame:
    return t.gt.groupBy("doc_id").agg(*(F.bool_or(F.col("label") == x).alias(f"has_{x}") for x in ("list", "title", "table", "figure", "math", "code")))
