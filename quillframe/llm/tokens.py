"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals for every limit.

A null text has no tokens and is counted as length 0, as an empty one is. Rows
with equal ids or texts all count. An empty table has an empty histogram. Other
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import cut, quoted

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids by a .tiktoken vocabulary; special tokens in texts are ordinary text."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _ENCODERS[path]


def lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """n_tokens of every row's text (column text), counted in batches: (n_tokens, n_docs) rows, not yet summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            n, docs = np.unique(np.fromiter((len(encode(x.as_py() or "")) for x in batch.column(0)), np.int64, batch.num_rows), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs.astype(np.int64))], names=["n_tokens", "n_docs"])

    return docs.select(quoted("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """n_tokens and n_docs of every length that occurs."""
    return lengths(docs, vocabulary).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 256) -> DataFrame:
    """For each length that occurs: what a context limit of that length means for the corpus.

    docs_longer, tokens_longer: documents over the limit and all their tokens;
    docs_upto, tokens_upto: the others; kept_tokens: total if each document is
    truncated at the limit; lost_tokens: what truncation loses. The sums run
    within blocks of lengths and over the blocks' totals, of which there are as
    many as the longest document has blocks, whatever the number of documents.
    """
    rows = cut(histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("block")))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    totals = totals.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    x = rows.join(totals, "block")
    x = x.withColumn("docs_longer", F.col("d_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0)))
    x = x.withColumn("tokens_longer", F.col("t_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0)))
    kept = F.col("t_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return x.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_upto"),
        (F.col("t_all") - F.col("tokens_longer")).alias("tokens_upto"),
        kept.alias("kept_tokens"),
        (F.col("t_all") - kept).alias("lost_tokens"),
    )


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not exceed; None of an empty table."""
    return sums.where(F.col("docs_upto") >= F.lit(share) * (F.col("docs_upto") + F.col("docs_longer"))).agg(F.min("n_tokens")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at any limit, whether or not a document has that length; 0 of an empty table."""
    below = sums.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("tokens_upto", "docs_longer"), "n_tokens")).first()[0]
    if below is None:
        row = sums.agg(F.max(F.col("docs_upto") + F.col("docs_longer"))).first()[0]
        return max(0, limit) * (row or 0)
    return below["tokens_upto"] + limit * below["docs_longer"]
