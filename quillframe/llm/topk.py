"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, each indexed by its value. A step (t, j) looks up
segment j of the unfinished queries at every value that differs from it in t
bits, verifies the whole Hamming distance of the codes found there and keeps
each query's k nearest. Steps go by t, then by j. What no step up to (t, j) has
found differs in more than t bits in segments up to j and in at least t in the
others, that is in more than segments * t + j bits: a query is finished as soon
as its kth distance is at most that. Rounds t = 0 to 2, 137 of 65,536 values a
segment, are one step each; from t = 3 on every segment is a step of its own.

Queries and codes meet by value: both sides are packed into one row for each
value and batch and dealt by value, and a task verifies a value's codes and
queries in blocks. Only values that some code has are looked up. Their counts,
at most 4 * 65,536 numbers whatever the corpus, are the driver's; by them a
value of many codes is split into a grid of blocks of its codes and its queries.

Codes are indexed and searched once however many rows have them; a code keeps
its k smallest ids, more can't be among a query's k nearest. Ties go to the
smaller id; a query finds itself at distance 0. If there are fewer than k rows,
all are returned. Rows whose id or vector is null are left out, as are null
components (bit 0). Rows with equal ids are ranked each. An empty table has no
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import attach, cut, quoted

BITS = 64
#: Codes of a value that one block holds.
BLOCK = 1 << 16
#: Pairs that a task compares at once, and looked-up values that it holds before they are packed.
PAIRS, LOOKED_UP = 1 << 21, 1 << 21
ENTRY = np.dtype([("code", "<i8"), ("first", "<i8"), ("n", "<i4")])
MET = "q long, distance int, first long, code long, n int"


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i of a code is set if component i is over zero; a vector of fewer components leaves the others unset."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        weight = -(1 << 63) if i == 63 else 1 << i
        code = code.bitwiseOR(F.when(F.get(vector, F.lit(i)) > 0, F.lit(weight).cast("long")).otherwise(F.lit(0).cast("long")))
    return code


def masks(width: int, flips: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), flips)], np.int64)


def segment(codes: np.ndarray, j: int, width: int) -> np.ndarray:
    return ((codes.view(np.uint64) >> np.uint64(j * width)) & np.uint64((1 << width) - 1)).astype(np.int64)


def first_ids(rows: DataFrame, k: int) -> DataFrame:
    """(code, id) -> (code, ids): the k smallest ids of each code, with repeats. The k smallest of each of 64 shares come first, so that a frequent code is no single task."""
    share = Window.partitionBy("code", "share").orderBy("id")
    few = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(share)).where(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    return few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def steps(width: int, segments: int) -> Iterator[list[tuple[int, int]]]:
    for t in range(width + 1):
        whole = [(t, j) for j in range(segments)]
        yield from [whole] if t < 3 else [[x] for x in whole]


def scatter(step: list[tuple[int, int]], width: int, counts: list[np.ndarray]):  # noqa: ANN201
    """A function of batches (asked, code, first, n or bound) -> packed rows (j, value, block, asked, entries) of a step."""
    flips = {t: masks(width, t) for t, _ in step}

    def packed(asked: bool, j: int, values: np.ndarray, blocks: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((blocks, values))
        values, blocks, entries = values[order], blocks[order], entries[order]
        starts = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (blocks[1:] != blocks[:-1]))))
        bounds = np.append(starts, len(values)).astype(np.int32) * np.int32(entries.dtype.itemsize)
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(entries).view(np.uint8))])
        n = len(starts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, j, np.int32)), pa.array(values[starts].astype(np.int32)), pa.array(blocks[starts]), pa.array(np.full(n, asked)), data], names=["j", "value", "block", "asked", "entries"])

    def spread(values: np.ndarray, side: np.ndarray, j: int, asked: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of a value split into a rows of code blocks and a columns of query blocks: the index of each entry, and the blocks that it goes to."""
        a = -(-counts[j][values] // BLOCK)
        own = (side.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % a
        at = np.repeat(np.arange(len(values)), a)
        k = np.arange(len(at)) - np.repeat(np.cumsum(a) - a, a)
        return at, (own[at] * a[at] + k if not asked else k * a[at] + own[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            for is_asked in (False, True):
                rows = np.flatnonzero(asked == is_asked)
                entries = np.empty(len(rows), ENTRY)
                for name, column in zip(ENTRY.names, columns, strict=True):
                    entries[name] = column[rows]
                for t, j in step if len(rows) else ():
                    own = segment(np.ascontiguousarray(entries["code"]), j, width)
                    each = max(1, LOOKED_UP // len(flips[t])) if is_asked else LOOKED_UP
                    for begin in range(0, len(rows), each):
                        part, values = entries[begin : begin + each], own[begin : begin + each]
                        if is_asked:
                            looked_up = values[:, None] ^ flips[t]
                            of, place = np.nonzero(counts[j][looked_up] > 0)
                            part, values = part[of], looked_up[of, place]
                        if len(values):
                            at, blocks = spread(values, np.ascontiguousarray(part["code"]), j, is_asked)
                            yield packed(is_asked, j, values[at], blocks, part[at])

    return run


def meet(step: list[tuple[int, int]], width: int, segments: int, k: int):  # noqa: ANN201
    """A function of packed rows, by j, value, block and codes before queries -> pairs (q, distance, first, code, n) that this step is the first to find, within the query's bound."""
    t = step[0][0]

    def fresh_pairs(queries: np.ndarray, j: np.ndarray, codes: np.ndarray) -> np.ndarray:
        apart = queries["code"] ^ codes["code"]
        distance = np.bitwise_count(apart.view(np.uint64)).astype(np.int32)
        fine = np.flatnonzero(distance <= queries["n"])
        for i in range(segments):
            # A pair is met at its first segment among those nearest to each other.
            near = np.bitwise_count(segment(apart[fine], i, width))
            fine = fine[np.where(i < j[fine], near > t, near >= t)]
        out = np.empty(len(fine), [("q", "<i8"), ("distance", "<i4"), *ENTRY.descr])
        out["q"], out["distance"] = queries["code"][fine], distance[fine]
        for name in ENTRY.names:
            out[name] = codes[name][fine]
        return out

    def nearest(found: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(found)
        x = x[np.lexsort((x["first"], x["distance"], x["q"]))]
        starts = np.flatnonzero(np.concatenate(([True], x["q"][1:] != x["q"][:-1]))) if len(x) else np.empty(0, np.int64)
        return x[np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x)))) < k]

    def batch_of(x: np.ndarray) -> pa.RecordBatch:
        names = ["q", "distance", "first", "code", "n"]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[n])) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, found, size = None, np.empty(0, ENTRY), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            asked = batch.column(3).to_numpy(zero_copy_only=False)
            packed = batch.column(4)
            bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
            entries = np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(ENTRY)
            many = np.diff(bounds) // ENTRY.itemsize
            group = np.cumsum(np.concatenate(([False], (keys[1:] != keys[:-1]).any(axis=1))))
            if now is None or (keys[0] != now).any():
                codes = codes[:0]
            is_query = np.repeat(asked, many)
            owner = np.repeat(group, many)
            held = np.bincount(owner[~is_query], minlength=group[-1] + 1)
            held[0] += len(codes)
            codes = np.concatenate([codes, entries[~is_query]])
            begins = np.cumsum(held) - held
            queries, owner, j = entries[is_query], owner[is_query], np.repeat(keys[:, 0], many)[is_query]
            pairs = held[owner]
            so_far = np.cumsum(pairs)
            at = 0
            while at < len(queries):
                stop = max(at + 1, int(np.searchsorted(so_far, so_far[at] - pairs[at] + PAIRS, "right")))
                n = pairs[at:stop]
                of = np.repeat(np.arange(at, stop), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begins[owner[of]]
                found.append(fresh_pairs(queries[of], j[of], codes[place]))
                size += len(found[-1])
                at = stop
                if size > PAIRS:
                    found = [nearest(found)]
                    if len(found[0]) > PAIRS // 2:
                        yield batch_of(found.pop())
                    size = sum(map(len, found))
            now, codes = keys[-1], codes[begins[-1] :]
        if size:
            yield batch_of(nearest(found))

    return run


def search_codes(queries: DataFrame, codes: DataFrame, k: int, segments: int = 4) -> DataFrame:
    """Distinct query codes (q) against distinct codes (code, ids) -> (q, code, distance): the codes of each query's k nearest rows, and perhaps some beyond."""
    width = BITS // segments
    tasks = codes.sparkSession.sparkContext.defaultParallelism
    # A query that asks for more rows than there are ends when all are found.
    n_codes, n_ids = codes.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    k = min(k, n_ids)
    empty = F.array().cast("array<struct<distance:int,first:bigint,code:bigint,n:int>>")
    entries = codes.select(F.lit(False).alias("asked"), "code", F.get("ids", F.lit(0)).alias("first"), F.size("ids").alias("n"))
    entries = cut(entries.repartition(max(tasks, -(-n_codes // 500_000))))
    values = entries.select(F.posexplode(F.array(*(F.shiftrightunsigned("code", j * width).bitwiseAND(F.lit((1 << width) - 1)) for j in range(segments)))).alias("j", "value"))
    counts = [np.zeros(1 << width, np.int64) for _ in range(segments)]
    for j, value, n in values.groupBy("j", "value").count().collect():
        counts[j][value] = n
    state = cut(queries.select("q", F.lit(BITS).alias("bound"), empty.alias("best")).repartition(tasks, "q"))
    finished = [state.where(F.lit(k == 0)).select("q", "best")]
    n_open = state.count() if k else 0
    for step in steps(width, segments):
        if not n_open:
            break
        parts = max(tasks, -(-n_open // 20_000))
        # So few tasks that a value's queries are few packed rows.
        looked_up = sum(comb(width, t) for t, _ in step)
        asked = state.repartition(max(1, n_open * looked_up // (2 * LOOKED_UP))).select(F.lit(True).alias("asked"), F.col("q").alias("code"), F.lit(0).cast("long").alias("first"), F.col("bound").alias("n"))
        packed = entries.unionByName(asked).mapInArrow(scatter(step, width, counts), "j int, value int, block long, asked boolean, entries binary")
        packed = packed.repartition(parts, "j", "value", "block").sortWithinPartitions("j", "value", "block", "asked")
        found = packed.mapInArrow(meet(step, width, segments, k), MET)
        before = state.select("q", F.explode_outer("best").alias("b")).select("q", "b.*")
        ranked = found.unionByName(before).repartition(parts, "q")
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.asc_nulls_last("distance"), "first"))).where(F.col("place") <= k)
        best = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("distance", "first", "code", "n")))).alias("best"))
        # The distance at which the codes so far have k rows.
        reached = F.aggregate("best", F.struct(F.lit(0).alias("n"), F.lit(BITS).alias("d")), lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when((a["n"] < k) & (a["n"] + x["n"] >= k), x["distance"]).otherwise(a["d"]).alias("d")), lambda a: a["d"])
        state = cut(best.select("q", reached.alias("bound"), "best"))
        over = F.col("bound") <= segments * step[-1][0] + step[-1][1]
        finished.append(state.where(over).select("q", "best"))
        state = state.where(~over)
        n_open = state.count()
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return out.select("q", F.explode("best").alias("b")).select("q", "b.code", "b.distance")


def hamming_top_k(vectors: DataFrame, k: int = 10, every: int = 20, segments: int = 4, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, neighbor_id, distance and rank: for each row whose id is divisible by every, its k nearest of all rows."""
    rows = vectors.select(quoted(id_column).cast("long").alias("id"), sign_code(quoted(vector)).alias("code")).where(F.col("id").isNotNull() & quoted(vector).isNotNull())
    rows = cut(rows)
    queries = rows.where(F.col("id") % every == 0).select("id", F.col("code").alias("q"))
    codes = cut(first_ids(rows, k))
    asked = queries.groupBy("q").agg(F.count("*").alias("n"))
    found = search_codes(asked.select("q"), codes, k, segments).join(codes, "code").select("q", "distance", F.explode("ids").alias("id"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("place") <= k)
    found = found.groupBy("q").agg(F.collect_list(F.struct("distance", "id", "place")).alias("found")).join(asked, "q")
    out = attach(queries, found, "q", queries.count()).select(F.col("id").alias("query_id"), F.explode("found").alias("x"))
    return out.select("query_id", F.col("x.id").alias("neighbor_id"), F.col("x.distance").cast("int").alias("distance"), F.col("x.place").cast("int").alias("rank"))
