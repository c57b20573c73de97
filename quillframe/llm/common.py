"""What several operators of this folder need: checkpoints in the shared folder, private column names, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; where that is unset and the master is local (tests), a new local one."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if where is None:
        where = context.getCheckpointDir()
    if where is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quillframe-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor costs no recomputation from the start."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame) -> DataFrame:
    """cut() of what is small beside the corpus, in no more partitions than there are cores, whatever number the shuffles before had."""
    return cut(df.coalesce(df.sparkSession.sparkContext.defaultParallelism))


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores until no column of taken has it (column names ignore case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text, null for neither; equal rows share it."""
    return F.md5(F.encode(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("t"), text), F.lit("null"))), "UTF-8"))


def text_key(text: Column) -> Column:
    """128 bits of a text, null for null: what holds of a text can be joined on it without moving ids."""
    return F.md5(F.encode(text, "UTF-8"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, also where f uses it inside a function of array elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def before(values: Column, zero: int, op: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For each place of an integer array, op over zero and all values before it. Blocks are folded first, so that an array of n places takes about n * block + (n / block)^2 steps, not n^2."""
    start = F.lit(zero).cast("int")

    def cut_up(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block))
        return F.when(F.size(v) > 0, blocks).otherwise(F.array().cast("array<array<int>>"))

    def folded(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda x: F.aggregate(x, start, op))
        starts = F.aggregate(whole, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        inner = lambda x, s: F.transform(x, lambda v, i: F.aggregate(F.slice(x, F.lit(1), i), s, op))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), inner))

    return let(let(values, cut_up), folded)


#: A key is hot if it has over so many rows, and over one row in so many.
HOT_ROWS, HOT_SHARE = 10_000, 100_000


def split_hot(facts: DataFrame, key: str, total: int, number: str = "n") -> tuple[DataFrame, DataFrame]:
    """The facts of hot keys, of which there are at most HOT_SHARE, to be broadcast; those of the others. facts has one row and the number of rows, of total, of each key."""
    hot = F.col(number) > max(HOT_ROWS, total // HOT_SHARE)
    return F.broadcast(facts.where(hot).drop(number)), facts.where(~hot).drop(number)


def attach(rows: DataFrame, facts: DataFrame, key: str, total: int, number: str = "n") -> DataFrame:
    """rows, of which there are total, with the columns of facts, which has one row and the number of rows of each key of rows.

    Hot keys are broadcast, so that their rows stay where they are; the others
    are joined by a shuffle or as Spark sees fit.
    """
    few, others = split_hot(facts, key, total, number)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(others, key))


def _edges_state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of any integer nodes -> (node, root): for each node but the roots, the smallest node it can reach.

    Alternating large-star and small-star rounds; each is joins and partial
    aggregations on edges only, so a hub with any number of links is split by
    adaptive skew joins and pre-aggregated before the shuffle. Every round is
    checkpointed; the number of rounds grows with the logarithm of the nodes.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut_few(edges)
    state = _edges_state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut_few(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = cut_few(moved.union(small.select("u", F.col("m").alias("v"))).distinct())
        was, state = state, _edges_state(edges)
        if was == state:
            break
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
