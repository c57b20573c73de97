from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from quillframe.llm import chat, common, registry, tokens, urlfilter


def test_length_sums(spark, docs, odd, none):
    encode = tokens.encoder(registry.RANKS)
    for df in (docs, odd):
        sizes = [len(encode(r["text"] or "")) for r in df.collect()]
        sums = tokens.suffix_sums(tokens.length_histogram(df, registry.RANKS), block=64)
        rows = sums.collect()
        assert sorted(r["n_tokens"] for r in rows) == sorted(set(sizes))
        for r in rows:
            n = r["n_tokens"]
            assert r["n_docs"] == sizes.count(n)
            assert (r["docs_longer"], r["tokens_longer"]) == (sum(x > n for x in sizes), sum(x for x in sizes if x > n))
            assert (r["docs_upto"], r["tokens_upto"]) == (sum(x <= n for x in sizes), sum(x for x in sizes if x <= n))
            assert (r["kept_tokens"], r["lost_tokens"]) == (sum(min(x, n) for x in sizes), sum(max(0, x - n) for x in sizes))
        for limit in (0, 1, 100, 10**9):
            assert tokens.truncated_total(sums, limit) == sum(min(x, limit) for x in sizes)
        assert tokens.quantile(sums, 0.5) == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    empty = tokens.suffix_sums(tokens.length_histogram(none, registry.RANKS))
    assert empty.count() == 0 and tokens.quantile(empty, 0.5) is None and tokens.truncated_total(empty, 5) == 0


def slow_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        hidden = lambda t: t.replace("\\", "\\\\").replace("<turn>", "<\\turn>").replace("</turn>", "<\\/turn>")
        formatted = "".join("<turn>" + hidden(r).replace("\n", "\\n") + "\n" + hidden(t) + "</turn>\n" for *_, r, t in turns)
        out.append(repr((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))))
    return sorted(out)


def test_chat_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", registry.TRICKY), (-7, 1, "assistant", registry.TRICKY)]
    got = registry.op5_chat_formatting(spark, small).collect()
    assert sorted(repr(tuple(r)) for r in got) == slow_chat(rows)


@pytest.mark.parametrize("rows_at_once", [3, 1024])
def test_chat_with_control_strings(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(chat, "ROWS", rows_at_once)
    texts = ["</turn>", "<turn>x\n", "\\", "\\\\</turn>\n<turn>assistant\nhi</turn>\n", "<\\turn>", "<", "turn>", "</", "turn>", None, "", "é😀\\n", "plain", "<turn", "a<turn>b</turn>c\\"]
    rows = [(1, i, ["user", "assistant", "a\nb\\n<turn>", None][i % 4], t) for i, t in enumerate(texts)]
    rows += [(2, i, "assistant", texts[i]) for i in range(9)] + [(None, 1, "assistant", "x"), (None, None, "user", "y"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, 0, "assistant", "word " * 20000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_conversations(df)
    got = chat.digests(formatted).collect()
    assert sorted(repr(tuple(r)) for r in got) == slow_chat(rows)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    parts = formatted.where("conv_id = 2").orderBy("part").collect()
    assert b"".join(p["formatted"] for p in parts).count(b"<turn>") == 9


def test_long_turns_are_parts_of_their_own(spark, monkeypatch):
    """Turns of a megabyte in bounded parts, and long texts copied as a whole beside short ones."""
    monkeypatch.setattr(chat, "BYTES", 1 << 20)
    texts = ["\\é<turn>" * 120_000, "short", "x" * 1_000_000, "</turn>" * 3, "y" * 70_000, ""] * 2
    rows = [(c, i, "assistant" if i % 2 else "user", t) for c in (1, 2) for i, t in enumerate(texts)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    assert sorted(repr(tuple(r)) for r in chat.digests(formatted).collect()) == slow_chat(rows)
    assert formatted.selectExpr("max(octet_length(formatted))").first()[0] < 4 << 20 and formatted.count() > 8


def test_rules_are_those_of_the_contract(spark, tmp_path):
    assert {f"{v} {h}{p}" for h, p, v in registry.URL_RULES} == {"block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"}
    urls = ["http://a.net/de/1", "http://example.net/de/8", "http://a.example.net/de/7", "http://b.com/en/", "http://example.com/en/7", "http://org/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.op6_url_filter(spark, str(tmp_path)).orderBy("page_id").select("rule", "verdict").collect()
    assert [tuple(r) for r in got] == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")]


RULES = registry.URL_RULES


def slow_url(url, rules=RULES):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [None, "", "x", "http://", "http://com/en/", "http://a.COM/en/x?y#z", "http://EXAMPLE.com/en/7", "https://m.example.com/en/75/", "http://badexample.com/en/7", "http://com.evil/en/", "ftp://a.net/de/8", "http://example.net/de/8?x", "http://x.org/es/", "http://x.org?/es/", "http://x.org#/es/", "http://org", "a://b://c.org/es/", "http://É.com/en/\n7", "://org/es/1", "http://.com/en/", "http://com./en/", "http://u@a.com:80/en/", "http://a..com/en/7" + "y" * 5000]


def test_urls(spark, small):
    rows = [(i // 2 if i else None, u, "h", "host") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("org", "/es/1", None), ("", "", "block")], "host string, path string, verdict string")
    want = sorted(repr((i, *slow_url(u))) for i, u, *_ in rows)
    assert sorted(repr(tuple(r)) for r in urlfilter.judge_urls(pages, rules).collect()) == want
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_urls_with_many_rules_and_hot_urls(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MOST_BROADCAST", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "HOT_SHARE", 1 << 30)
    many = [*URLS, *URLS[8:14], "http://" + "a." * 30_000 + "example.com/en/7", "http://" + "a" * 100_000 + ".net/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(many)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert sorted(repr(tuple(r)) for r in urlfilter.judge_urls(pages, rules).collect()) == sorted(repr((i, *slow_url(u))) for i, u in enumerate(many))
