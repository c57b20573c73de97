"""The queries of this folder: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import chat, decontaminate, language, packing, pii, simhash, tokens, topk, urlfilter, warc
from quillframe.llm.sql import ORACLES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
TRICKY = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.fit(docs, rest != 2)
    return language.predict(docs, model).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.length_histogram(table(spark, sf_dir, "documents"), RANKS))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select cast(-7 as long) conv_id, cast(pos as long) turn, col role from (select posexplode(array('user', 'assistant')))").withColumn("text", F.lit(TRICKY))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"select * from values {values} as rules(host, path, verdict)")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.hamming_top_k(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", F.lower("record_type").alias("record_type"), "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.KINDS[:4]), F.sha2(F.encode(pii.listed(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash_near_dedup, op2_language_id, op3_best_fit_packing, op4_token_counts, op5_chat_formatting, op6_url_filter, op7_hamming_top_k, op8_warc, op9_pii, op10_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
