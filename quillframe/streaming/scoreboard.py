"""A running scoreboard: sums that new rows are added to, and ratios of the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def totals(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Sums and the number of rows by by: the same of a table and of a stream."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))


def run_available(spark: SparkSession, stream: DataFrame, by: list[str], sums: list[str], folder: str) -> DataFrame:
    """Adds what the stream has now to the scoreboard in folder and returns that.

    Spark keeps the sums and the stream's place in folder's checkpoint, so a
    later call, or one after a failure, goes on from there and counts no row
    twice; each batch replaces the scoreboard as it was before it. The state has
    one row for each key, whatever the number of rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/board/{number}")

    query = totals(stream, by, sums).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{folder}/board/*").select("*", F.regexp_extract(F.col("_metadata.file_path"), r"/board/(\d+)/", 1).cast("long").alias("batch"))
    newest = last.agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/board/{newest}")
