"""Benchmark decontamination: a broadcast set of normalised test n-grams, looked up at every window of the documents' words.

Words are runs of letters and digits of ASCII and of anything beyond it, with
A-Z in lower case. A benchmark item's windows are its n-grams; one of fewer
words has one window, all of it. Windows are joined by their words, not by a
hash, so every hit is verified. Long documents are cut into overlapping chunks
of bounded size first. A window's words are put together only if the bit of
its first, middle and last word is set in a table of bits that the benchmark's
windows set, a constant of the plan whose size is bounded; the join decides. All of it is
DataFrame operations.

A null, empty or wordless text has no windows. A benchmark row without an
item_id makes hits but is not counted as an item. Rows with equal ids are
judged each. Without benchmark windows nothing is hit. Other columns are
ignored, and kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import ascii_lower, cut, fresh, quoted, text_key

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Window sets are broadcast up to so many bytes of words and items; more are joined by a shuffle.
MOST_BROADCAST = 64 << 20
#: Distinct texts to drop up to this number are broadcast, 32 bytes each.
MOST_TEXTS = 500_000
#: Bits of the table, as a power of two: at least and at most; in between sixteen for each window.
LEAST_BITS, MOST_BITS = 12, 21
#: Words of a chunk.
CHUNK = 2048


def words_of(text: Column) -> Column:
    """The words of a text; empty for null."""
    found = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1)
    return F.filter(found, lambda w: w != "")


def gram_at(words: Column, size: int, i: Column) -> Column:
    """The size words from the i-th (from 1) on."""
    return F.array_join(F.slice(words, i, size), " ")


def starts_of(words: Column, size: int) -> Column:
    """The places (from 1) of all runs of size words; null if there are fewer."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1)))


def bit_of(words: Column, size: Column, i: Column, bits: int) -> Column:
    """The number of the bit, in a table of 2 to the power of bits, of the size words from the i-th (from 1) on: three of them tell most windows apart."""
    at = lambda k: F.get(words, (k - 1).cast("int"))
    return F.xxhash64(at(i), at(i + F.floor(size / 2)), at(i + size - 1)).bitwiseAND(F.lit((1 << bits) - 1))


def bit_table(windows: DataFrame) -> tuple[Column, int]:
    """A constant array of 64-bit words with the windows' bits set, and the number of bits as a power of two."""
    n = windows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    at = bit_of(F.split("gram", " "), F.col("n_gram"), F.lit(1), bits)
    packed = windows.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("x"))
    table = ["0"] * (1 << (bits - 6))
    for r in packed.collect():
        table[r["w"]] = str(r["x"])
    # One literal, which the optimizer turns into an array once.
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>"), bits


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """gram, n_gram (its words) and items (distinct ids) of all distinct windows."""
    b = benchmark.select(quoted("item_id").alias("item_id"), words_of(quoted("text")).alias("words")).where("size(words) > 0")
    every = F.transform(starts_of(F.col("words"), size), lambda i: gram_at(F.col("words"), size, i))
    w = b.select("item_id", F.least(F.size("words"), F.lit(size)).alias("n_gram"), F.explode(F.coalesce(every, F.array(F.array_join("words", " ")))).alias("gram"))
    return w.groupBy("gram", "n_gram").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs (key columns, words) -> key columns, at, n_gram and items of each window's occurrences; words are dropped."""
    return hits_or_line(docs, cut(windows)).where("at is not null")


def covered(spans: Column) -> Column:
    """The number of words in the union of sorted (at, n_gram) structs."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["at"] + x["n_gram"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["n_gram"] - F.greatest(acc["end"], x["at"]))).alias("n"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    Each row gets a number and one line of its own that passes by the join, so
    the texts are read once and only hits and those lines are shuffled.
    """
    d = docs.select(quoted("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(quoted("text")).alias("words"))
    d = d.select("doc_id", "row", F.size("words").alias("n_words"), "words")
    windows = cut(benchmark_windows(benchmark, size))
    found = hits_or_line(d, windows)
    per = found.groupBy("row", "doc_id", "n_words").agg(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "n_gram"))).alias("spans"), F.collect_set("items").alias("items"))
    spans = F.array_sort("spans")
    items = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda i: i.cast("string")))
    out = per.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered(spans).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256).alias("items_sha256"))
    return out.select("*", (F.col("n_hit") > 0).alias("contaminated"))


def hits_or_line(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """hits() of docs (key columns, words), and for each row of docs one row with nulls."""
    sizes = [r[0] for r in windows.select("n_gram").distinct().orderBy("n_gram").collect()]
    octets = F.octet_length("gram") + 24 * (F.size("items") + 2) + F.coalesce(F.octet_length(F.array_join(F.transform("items", lambda i: i.cast("string")), "")), F.lit(0))
    few = windows.agg(F.coalesce(F.sum(octets.cast("long")), F.lit(0))).first()[0] <= MOST_BROADCAST
    table, bits = bit_table(windows)
    keys = [c for c in docs.columns if c != "words"]
    longest = max(sizes, default=1)
    line = F.array(F.struct(F.lit(-1).alias("start"), F.array().cast("array<string>").alias("words")))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    chunk = F.concat(line, F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, CHUNK + longest - 1).alias("words"))))
    chunks = docs.select(*keys, F.explode(chunk).alias("c")).select(*keys, "c.start", "c.words")

    def marked(n: int) -> Column:
        def is_set(i: Column) -> Column:
            b = bit_of(F.col("words"), F.lit(n), i, bits)
            return F.getbit(F.get(table, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

        found = F.filter(starts_of(F.col("words"), n), is_set)
        return F.coalesce(F.transform(found, lambda i: F.struct((i - 1 + F.col("start")).alias("at"), gram_at(F.col("words"), n, i).alias("gram"))), none)

    none = F.array().cast("array<struct<at:int,gram:string>>")
    own = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("gram")))
    every = F.when(F.col("start") < 0, own).otherwise(F.concat(none, *(marked(n) for n in sizes)))
    w = chunks.select(*keys, F.explode(every).alias("w")).select(*keys, F.col("w.at").alias("at"), F.col("w.gram").alias("gram"))
    if few:
        joined = w.join(F.broadcast(windows), "gram", "left")
    else:
        lines = w.where("at is null").select(*keys, F.lit(None).cast("string").alias("gram"), "at", F.lit(None).cast("int").alias("n_gram"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
        joined = w.join(windows, "gram").select(*keys, "gram", "at", "n_gram", "items").unionByName(lines)
    return joined.where("at is null or n_gram is not null").select(*keys, "at", "n_gram", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without the rows in whose text a benchmark window occurs. What holds of a text holds of its copies: the rows are dropped by their text."""
    key = fresh("decontaminate_key", docs.columns)
    d = docs.select(text_key(quoted("text")).alias("key"), words_of(quoted("text")).alias("words"))
    bad = cut(hits(d, benchmark_windows(benchmark, size)).select(F.col("key").alias(key)).distinct())
    few = bad.count() <= MOST_TEXTS
    return docs.withColumn(key, text_key(quoted("text"))).join(F.broadcast(bad) if few else bad, key, "left_anti").drop(key)
