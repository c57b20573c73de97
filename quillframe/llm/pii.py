"""Personal data by weak supervision, in DataFrame operations alone.

Base spans are what four patterns find and their checks confirm: e-mail
addresses, IPv4 addresses, card and telephone numbers. Beyond them, long tokens
with digits are candidates for secrets. Labelers vote on each: its shape
(regular expressions), the word before it (a gazetteer) and its context. The
corpus-wide counts of vote patterns, at most a few thousand rows whatever the
corpus, go through expectation-maximisation, which estimates how reliable each
labeler is; its posteriors train the final classifier, a logistic regression
on the span's features, whose weights become column expressions.

Positions count code points from 0, ends are exclusive. A null text is an
empty one. Rows with equal ids are judged each. If no token is a candidate, the
method adds no spans. Other columns are ignored, and kept by redact().
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import before, fresh, let, quoted

#: Possessive forms of the patterns, which match the same: nothing after a repeated group can use what it would give back. An address's first part is tried from the beginning of its run of characters only, as a match from within it would have been one from there.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{12,}+"
KINDS = ("email", "ip", "card", "phone", "secret")
#: Words that announce a secret, and words that announce an ordinary number.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "credentials", "signature", "iban", "ssn")
PLAIN_WORDS = ("page", "pages", "version", "isbn", "issn", "doi", "year", "figure", "table", "chapter", "line", "commit", "revision", "sha", "md5", "checksum", "number", "no", "nr", "order")
SPAN = "struct<start:int,ord:int,end:int,kind:string>"
FOUND = "array<struct<start:int,end:int,text:string>>"
AROUND = "array<struct<start:int,end:int,token:string,before:string,after:string>>"
#: Beyond every place.
FAR = 2**31 - 1
VOTES = ("v_shape", "v_word", "v_sign", "v_quote", "v_variety")
FEATURES = ("f_kind", "f_length", "f_sign", "f_word")


def located(matches: Column, between: Column) -> Column:
    """(start, end, text) of the matches: the lengths of what is before, between and after them and of themselves add up to their places."""
    gaps = F.transform(F.slice(between, F.lit(1), F.size(matches)), F.length)
    starts = before(F.zip_with(matches, gaps, lambda m, g: F.length(m) + g), 0, lambda a, x: a + x)
    placed = F.arrays_zip(matches.alias("m"), gaps.alias("g"), starts.alias("s"))
    return F.transform(placed, lambda x: F.struct((x["s"] + x["g"]).alias("start"), (x["s"] + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("text")))


def spans_of(found: Column, kind: str) -> Column:
    at = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def with_located(df: DataFrame, t: Column, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with an array of the located matches of each pattern; a text in which its quick pattern has no match skips it."""
    found = {n: [fresh(f"{n}_{x}", df.columns) for x in ("matches", "between")] for n in patterns}
    none = F.array().cast("array<string>")
    d = df.select("*", *(F.when(t.rlike(q), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(found[n][0]) for n, (q, p) in patterns.items()))
    d = d.select("*", *(F.when(F.size(quoted(found[n][0])) > 0, F.split(t, p, -1)).otherwise(none).alias(found[n][1]) for n, (q, p) in patterns.items()))
    whole = {n: F.when(F.size(quoted(a)) > 0, located(quoted(a), quoted(b))).otherwise(F.array().cast(FOUND)) for n, (a, b) in found.items()}
    return d.select("*", *(c.alias(n) for n, c in whole.items()))


def with_base(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with an array of its base spans, by start and then kind. Texts without "@", "+" or a digit skip the patterns."""
    t = F.coalesce(quoted(text), F.lit(""))
    names = [fresh(f"pii_{x}", df.columns) for x in KINDS[:4]]
    quick = (r"@", r"[0-9]\.[0-9]", r"[0-9]", r"\+[0-9]")
    d = with_located(df, t, dict(zip(names, zip(quick, (EMAIL, IP, CARD, PHONE), strict=True), strict=True)))
    n_digits = lambda x, a, b: F.length(digits(x["text"])).between(a, b)
    email, ip, card, phone = (quoted(n) for n in names)
    ip = F.filter(ip, lambda x: x["text"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    card = F.filter(card, lambda x: F.when(n_digits(x, 12, 19), F.call_function("luhn_check", digits(x["text"]))).otherwise(F.lit(False)))
    phone = F.filter(phone, lambda x: n_digits(x, 9, 15))
    every = F.concat(*(spans_of(x, k) for x, k in zip((email, ip, card, phone), KINDS, strict=False)))
    return d.withColumn(name, F.array_sort(every)).select(*(quoted(c) for c in df.columns), name)


def with_candidates(df: DataFrame, text: str, base: str, name: str) -> DataFrame:
    """df with an array of candidate tokens: place, text and what is around; none that a base span overlaps.

    The 24 characters before a token are the end of what is before it, back to
    the second token before, which with it has more; the two after it likewise.
    """
    t = F.coalesce(quoted(text), F.lit(""))
    matches, between, tokens, both = (fresh(f"pii_{x}", [*df.columns, name]) for x in ("matches", "between", "tokens", "both"))
    none = F.array().cast("array<string>")
    d = df.select("*", F.when(t.rlike("[0-9]"), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))).otherwise(none).alias(matches))
    d = d.select("*", F.when(F.size(matches) > 0, F.split(t, TOKEN, -1)).otherwise(none).alias(between))
    m, b = quoted(matches), quoted(between)
    part = lambda x, i: F.coalesce(F.get(x, i), F.lit(""))

    def around(x: Column, i: Column) -> Column:
        head = F.concat(part(m, i - 2), part(b, i - 1), part(m, i - 1), part(b, i))
        tail = F.concat(F.substring(part(b, i + 1), 1, 2), F.substring(part(m, i + 1), 1, 1))
        return F.struct(x["start"], x["end"], x["text"].alias("token"), F.right(head, F.lit(24)).alias("before"), F.substring(tail, 1, 2).alias("after"))

    placed = F.transform(located(m, b), around)
    d = d.select("*", F.when(F.size(m) > 0, placed).otherwise(F.array().cast(AROUND)).alias(tokens))
    # Both are sorted, and a token overlaps the spans of a few kinds at most: those that begin before it ends reach at most as far as any of them does.
    spans = F.transform(quoted(base), lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("token"), x["end"].alias("end")))
    whole = F.transform(quoted(tokens), lambda x, i: F.struct(x["start"].alias("start"), (i + 1).alias("token"), x["end"].alias("end")))
    merged = quoted(both)
    reach = before(F.transform(merged, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
    following = F.reverse(before(F.reverse(F.transform(merged, lambda x: F.when(x["token"] == 0, x["start"]).otherwise(FAR))), FAR, lambda a, x: F.least(a, x)))
    free = F.filter(F.arrays_zip(merged.alias("x"), reach.alias("r"), following.alias("f")), lambda z: (z["x"]["token"] > 0) & (z["r"] <= z["x"]["start"]) & (z["f"] >= z["x"]["end"]))
    d = d.select("*", F.when((F.size(quoted(base)) > 0) & (F.size(quoted(tokens)) > 0), F.sort_array(F.concat(spans, whole))).otherwise(F.array().cast("array<struct<start:int,token:int,end:int>>")).alias(both))
    kept = F.when(F.size(quoted(base)) == 0, quoted(tokens)).otherwise(F.transform(free, lambda z: F.element_at(quoted(tokens), z["x"]["token"])))
    return d.select(*(quoted(c) for c in df.columns), F.when(F.size(quoted(tokens)) > 0, kept).otherwise(F.array().cast(AROUND)).alias(name))


def kind_of(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), "digits").when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").otherwise("mixed")


def word_before(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z_]*$", 1))


def sign_of(before: Column) -> Column:
    return F.when(before.rlike(r"[=:]\s?[\"'`]?$"), "set").when(before.rlike(r"[A-Za-z]\s$"), "prose").otherwise("other")


def labelled(c: Column) -> list[Column]:
    """The labelers' votes (1, -1 or 0 for none) and the classifier's features of a candidate struct."""
    token, before = c["token"], c["before"]
    kind, length, word, sign = kind_of(token), F.length(token), word_before(before), sign_of(before)
    variety = F.size(F.array_distinct(F.split(token, "")))
    quote = F.regexp_extract(before, "([\"'`])$", 1)
    word_kind = F.when(word.isin(*SECRET_WORDS), "secret").when(word.isin(*PLAIN_WORDS), "plain").otherwise("other")
    return [
        F.when(kind == "digits", -1).when(length >= F.when(kind == "hex", 32).otherwise(20), 1).otherwise(0).alias("v_shape"),
        F.when(word_kind == "secret", 1).when(word_kind == "plain", -1).otherwise(0).alias("v_word"),
        F.when(sign == "set", 1).when(sign == "prose", -1).otherwise(0).alias("v_sign"),
        F.when((quote != "") & (F.substring(c["after"], 1, 1) == quote), 1).when(c["after"].rlike(r"^(?:%|\s?[€$])"), -1).otherwise(0).alias("v_quote"),
        F.when((variety >= 11) & (kind != "digits"), 1).when(variety <= 4, -1).otherwise(0).alias("v_variety"),
        kind.alias("f_kind"),
        F.when(length < 20, "short").when(length < 32, "middle").when(length < 64, "long").otherwise("huge").alias("f_length"),
        sign.alias("f_sign"),
        word_kind.alias("f_word"),
    ]


@dataclass
class Model:
    """reliability: by labeler, how often a vote of 1, 0 or -1 is cast on secrets and on other tokens. weights: by feature and value."""

    prior: float = 0.0
    reliability: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)
    bias: float = -10.0
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def accepts(self, c: dict[str, Column]) -> Column:
        """Whether the classifier takes a candidate with these feature columns for a secret."""
        total = F.lit(self.bias)
        for name, values in sorted(self.weights.items()):
            weight = F.lit(0.0)
            for value, w in sorted(values.items()):
                weight = F.when(c[name] == value, F.lit(w)).otherwise(weight)
            total = total + weight
        return total > 0


def expectation_maximisation(patterns: dict[tuple[int, ...], float], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Prior, the labelers' reliabilities and each vote pattern's posterior, from the patterns' counts. It starts from the majority of votes."""
    posterior = {p: min(0.95, max(0.05, 0.5 + sum(p) / (2 * len(p)))) for p in patterns}
    total = sum(patterns.values())
    prior, table = 0.0, []
    for _ in range(rounds):
        yes = sum(n * posterior[p] for p, n in patterns.items())
        prior = (yes + 1) / (total + 2)
        table = []
        for j in range(len(next(iter(patterns), ()))):
            cast = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, n in patterns.items():
                cast[p[j]][0] += n * posterior[p]
                cast[p[j]][1] += n * (1 - posterior[p])
            table.append({v: (a / (yes + 3), b / (total - yes + 3)) for v, (a, b) in cast.items()})
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(p))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, table, posterior


def logistic(rows: list[tuple[tuple[str, ...], float, float]], rounds: int = 400, decay: float = 1e-3) -> tuple[float, list[dict[str, float]]]:
    """Bias and weights of values by feature, from (values, share of secrets, count) rows, by gradient descent."""
    total = sum(n for *_, n in rows)
    bias, weights = 0.0, [dict.fromkeys({r[0][j] for r in rows}, 0.0) for j in range(len(rows[0][0]))]
    for _ in range(rounds):
        slope, slopes = 0.0, [dict.fromkeys(w, 0.0) for w in weights]
        for values, share, n in rows:
            odds = bias + sum(w[v] for w, v in zip(weights, values, strict=True))
            error = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - share)
            slope += error
            for s, v in zip(slopes, values, strict=True):
                s[v] += error
        bias -= 2.0 * slope
        for w, s in zip(weights, slopes, strict=True):
            for v in w:
                w[v] -= 2.0 * (s[v] + decay * w[v])
    return bias, weights


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of all candidates of docs."""
    d = with_base(docs.select(quoted(text).alias("text")).where(F.col("text").rlike("[0-9]") & F.col("text").rlike(TOKEN)), "text", "base")
    d = with_candidates(d, "text", "base", "candidates").select(F.explode_outer("candidates").alias("c"))
    # An inner explode would have Spark compute all of the above once more as a filter.
    d = d.where("c is not null")
    rows = d.select(*labelled(F.col("c"))).groupBy(*VOTES, *FEATURES).count().collect()
    if not rows:
        return Model()
    patterns: dict[tuple[int, ...], float] = {}
    for r in sorted(rows):
        key = tuple(r[v] for v in VOTES)
        patterns[key] = patterns.get(key, 0) + r["count"]
    prior, table, posterior = expectation_maximisation(patterns)
    soft: dict[tuple[str, ...], list[float]] = {}
    for r in sorted(rows):
        x = soft.setdefault(tuple(r[f] for f in FEATURES), [0.0, 0.0])
        x[0] += r["count"] * posterior[tuple(r[v] for v in VOTES)]
        x[1] += r["count"]
    bias, weights = logistic([(k, a / n, n) for k, (a, n) in sorted(soft.items())])
    return Model(prior, dict(zip(VOTES, table, strict=True)), bias, dict(zip(FEATURES, weights, strict=True)))


def with_spans(df: DataFrame, model: Model, text: str, base: str, name: str) -> DataFrame:
    """df with the arrays base and name: base spans, and all spans by start and then kind."""
    candidates = fresh("pii_candidates", [*df.columns, base, name])
    d = with_candidates(with_base(df, text, base), text, base, candidates)
    at = KINDS.index("secret")

    def accepted(x: Column) -> Column:
        values = labelled(x)[len(VOTES) :]
        return model.accepts(dict(zip(FEATURES, values, strict=True)))

    taken = F.filter(quoted(candidates), accepted)
    added = F.transform(taken, lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("ord"), x["end"].alias("end"), F.lit("secret").alias("kind")))
    return d.withColumn(name, F.array_sort(F.concat(quoted(base), added))).drop(candidates)


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, base_spans and spans of every row of docs; the model is fitted on docs unless one is given."""
    model = model or fit(docs)
    d = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").cast("string").alias("text"))
    return with_spans(d, model, "text", "base_spans", "spans").select("doc_id", "base_spans", "spans")


def redacted(text: Column, spans: Column, block: int = 4096) -> Column:
    """text with each span, or union of overlapping spans, replaced by the first one's kind in brackets.

    What stays is cut out of blocks of the text, so that a cut takes a block's
    time, not the text's.
    """
    reach = before(F.transform(spans, lambda x: x["end"]), 0, lambda a, x: F.greatest(a, x))
    both = F.filter(F.arrays_zip(spans.alias("x"), reach.alias("r")), lambda z: z["x"]["start"] >= z["r"])

    def piece(blocks: Column, a: Column, n: Column) -> Column:
        first = F.floor(a / block).cast("int")
        some = F.slice(blocks, first + 1, F.floor((a + n) / block).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), a - first * block + 1, n)

    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    kept = lambda blocks: F.transform(both, lambda z: F.concat(piece(blocks, z["r"], z["x"]["start"] - z["r"]), F.lit("["), F.upper(z["x"]["kind"]), F.lit("]")))
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(let(cuts, lambda blocks: F.concat(F.array_join(kept(blocks), ""), piece(blocks, last, F.length(text) - last))))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with the spans in column text replaced by their kinds; n_chars, if there, is that of the new text."""
    model = model or fit(docs)
    base = fresh("pii_base", docs.columns)
    spans = fresh("pii_spans", docs.columns)
    d = with_spans(docs, model, "text", base, spans).withColumn("text", redacted(quoted("text"), quoted(spans)))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(quoted("n_chars").isNull() | (F.size(quoted(spans)) == 0), quoted("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return d.select(*(quoted(c) for c in docs.columns))
