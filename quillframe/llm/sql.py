"""DuckDB SQL for the queries of this folder that SQL can express."""

URLS = """
with p as (select page_id, url, contains(url, '://') as ok, substr(url, strpos(url, '://') + 3) as rest from pages),
q as (select page_id, case when ok then translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
  case when ok then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path, row_number() over () as n from p),
rules(rule_host, rule_path, rule_verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (select n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(rule_verdict, length(rule_host || rule_path)) as v
  from q join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by n)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(v, 'allow') as verdict from q left join m using (n)
"""

TOP_K = """
with codes as (select vec_id as id, list_transform(range(64), lambda i: case when embedding[i + 1] > 0 then 1 else 0 end) as bits from embeddings where vec_id is not null and embedding is not null),
d as (select q.id as query_id, x.id as neighbor_id, cast(list_sum(list_transform(range(64), lambda i: case when q.bits[i + 1] <> x.bits[i + 1] then 1 else 0 end)) as integer) as distance
  from codes q join codes x on q.id % 20 = 0)
select query_id, neighbor_id, distance, cast(n as integer) as rank from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as n from d) where n <= 10
"""

WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
LEAKS = f"""
with d as (select row_number() over () as n, doc_id, coalesce({WORDS}, []) as words from documents),
b as (select item_id, {WORDS} as words from benchmark),
bw as (select distinct item_id, least(len(words), 10) as size, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') as gram
  from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)),
sizes as (select distinct size from bw),
dw as (select n, i, size, array_to_string(words[i : i + size - 1], ' ') as gram from (select n, words, size, unnest(range(1, len(words) - size + 2)) as i from d, sizes where len(words) >= size)),
hits as (select n, i, dw.size, item_id from dw join bw on dw.gram = bw.gram and dw.size = bw.size),
hit_words as (select n, count(distinct w) as n_hit from (select n, unnest(range(i, i + size)) as w from (select distinct n, i, size from hits)) group by n),
items as (select n, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct n, cast(item_id as varchar) as item from hits where item_id is not null) group by n)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (n) left join items using (n)
"""

ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + (length({0}) - length(replace({0}, '<turn>', ''))) // 6 + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"
CHATS = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(15 + {ESCAPED.format("role")} + length(role) - length(replace(role, chr(10), '')) + {ESCAPED.format("text")}) as bigint) as formatted_chars
from t group by conv_id
"""

PAGES = """
with d as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
f as (select *, min(page_id) over (partition by hex) as first from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, 5 * (i // 4) + 1, 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), '') as payload_digest,
  case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from f
"""

ORACLES = {"op5_chat_formatting": CHATS, "op8_warc": PAGES, "op6_url_filter": URLS, "op7_hamming_top_k": TOP_K, "op10_decontamination": LEAKS}
