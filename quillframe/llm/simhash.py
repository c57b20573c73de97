"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits share a variant that is within
r/2 bits of both, so every fingerprint emits its ball of radius r/2 and
colliding variants are the candidates. The ball of a 64-bit fingerprint at r=4
has 2,081 variants; to shuffle them all would move some 30 KB a document.
Here the shuffle carries a ball's *prefix* variants only (137 for 16 bits, each
with the flips that are left), and the rest of the ball is unfolded by the
task that owns the prefix, in bounded slices. The variants that meet are the
same. How many entries each prefix has, 65,536 numbers whatever the corpus, is
counted first; where one has too many for a task, further bits are settled
before the shuffle.

Null, empty and blank texts have fingerprint zero and are linked like any
other. Rows with equal ids or equal texts all stay. A null id never becomes a
component's id unless all ids of the component are null. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import attach, connected_components, cut, cut_few, fresh, quoted, row_key

PREFIX = 16
#: Variants unfolded at once by a task: 64 MB of them.
SLICE = 1 << 23
#: Packed prefix variants that a task gets on average, and that one prefix may have before it is split.
PER_TASK, PER_PREFIX = 1_000_000, 4_000_000
#: Prefixes that are next to each other share a packed row unless one is split.
SHARED = 4
ENTRY = np.dtype([("key", "<u2"), ("left", "u1"), ("fp", "<u8")])
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, words_per_shingle: int) -> int:
    """The SimHash of a UTF-8 text: a bit is set if it is in more than half of the shingles' XXH64 hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    n = len(words) - words_per_shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words_per_shingle: int = 4, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "fp") -> DataFrame:
    """The columns keep and the fingerprint of text as a signed 64-bit integer, one row per row of df."""
    rows = df.select(*(quoted(k) for k in keep), quoted(text).cast("string").cast("binary").alias(fresh("simhash_text", list(keep))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.fromiter((fingerprint(x.as_py(), words_per_shingle) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], name])

    schema = rows.drop(rows.columns[-1]).schema.add(name, "long")
    return rows.mapInArrow(run, schema)


@cache
def masks(bits: int, flips: int) -> np.ndarray:
    """All masks of exactly flips of the lowest bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), flips)], np.uint64)


def unfold(fps: np.ndarray, left: np.ndarray, head: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants whose bits above low are head and whose low bits differ from fps in up to left flips; the index of each variant's fingerprint."""
    under = np.uint64((1 << low) - 1) if low < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    base = (fps & under) | head
    made, of = [], []
    for flips in range(int(left.max(initial=0)) + 1):
        at = np.flatnonzero(left >= flips)
        m = masks(low, flips)
        if len(at) and len(m):
            made.append((base[at][:, None] ^ m).ravel())
            of.append(np.repeat(at, len(m)))
    return np.concatenate(made), np.concatenate(of)


def collide(fps: np.ndarray, left: np.ndarray, head: np.ndarray, low: int, radius: int) -> np.ndarray:
    """Links (smaller, larger fingerprint), verified, of the fingerprints that share a variant: each with the smallest of that variant.

    All that share a variant are within the radius of each other, so the links
    with the smallest are enough and no pairs within a group are listed.
    """
    none = np.empty((0, 2), np.uint64)
    if len(fps) < 2:
        return none
    total = sum(int((left >= f).sum()) * len(masks(low, f)) for f in range(int(left.max()) + 1))
    if total > SLICE and low > 0:
        # Too many for a slice: settle the next bits first, as the shuffle did for the prefix.
        step = min(4, low)
        shift = np.uint64(low - step)
        mine = (fps >> shift) & np.uint64((1 << step) - 1)
        found = []
        for value in range(1 << step):
            need = np.bitwise_count(mine ^ np.uint64(value))
            at = np.flatnonzero(need <= left)
            found.append(collide(fps[at], (left[at] - need[at]).astype(np.int64), head[at] | (np.uint64(value) << shift), low - step, radius))
        return np.concatenate(found)
    variants, of = unfold(fps, left, head, low)
    order = np.sort(variants)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return none
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.searchsorted(twice, variants)
    at[at == len(twice)] = 0
    hit = np.flatnonzero(twice[at] == variants)
    group, member = at[hit], fps[of[hit]]
    order = np.lexsort((member, group))
    group, member = group[order], member[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    lead = member[np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))]
    ok = (lead != member) & (np.bitwise_count(lead ^ member) <= radius)
    return np.unique(np.stack([lead[ok], member[ok]], axis=1), axis=0) if ok.any() else none


def forest(links: np.ndarray) -> np.ndarray:
    """Links (root, node) that connect what links connects: one for each node but the smallest of its component."""
    nodes, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(links.shape).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[label[moved]], nodes[moved]], axis=1)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v) links, perhaps repeated, that connect all pairs of the distinct 64-bit fingerprints fp within radius bits of each other."""
    half = radius // 2
    if radius % 2:
        raise ValueError("an even radius is needed to meet in the middle")
    flips = [(np.uint64(m), half - f) for f in range(half + 1) for m in masks(PREFIX, f).tolist()]

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return fp, fp >> np.uint64(64 - PREFIX)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << PREFIX, np.int64)
        for batch in batches:
            own = np.bincount(keys_of(batch)[1].astype(np.int64), minlength=1 << PREFIX)
            counts += own
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["key", "n"])

    own = np.zeros(1 << PREFIX, np.int64)
    for key, n in fps.mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n")).collect():
        own[key] = n
    entries = sum(own[np.arange(1 << PREFIX) ^ int(mask)] for mask, _ in flips)
    depth = np.zeros(1 << PREFIX, np.int64)
    for bits in (8, 4):
        depth[entries * sum(len(masks(bits, f)) for f in range(half + 1)) <= PER_PREFIX << bits] = bits
    depth[entries > PER_PREFIX] = np.where(depth[entries > PER_PREFIX] == 0, 8, depth[entries > PER_PREFIX])
    depth[entries <= PER_PREFIX] = 0
    buckets = int(min(1 << 20, max(fps.sparkSession.sparkContext.defaultParallelism, entries.sum() // PER_TASK)))

    def packed(bucket: np.ndarray, low: int, found: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket, found = bucket[order], found[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        bounds = np.append(starts, len(bucket)).astype(np.int32) * np.int32(ENTRY.itemsize)
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(found.view(np.uint8))])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), low, np.int32)), pa.array(bucket[starts]), data], names=["low", "bucket", "entries"])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key = keys_of(batch)
            if not len(fp):
                continue
            made = np.empty((len(flips), len(fp)), ENTRY)
            for row, (mask, left) in zip(made, flips, strict=True):
                row["key"], row["left"], row["fp"] = key ^ mask, left, fp
            made = made.ravel()
            deep = depth[made["key"]]
            whole = made[deep == 0]
            if len(whole):
                yield packed(whole["key"].astype(np.int64) >> SHARED, 64 - PREFIX, whole)
            for bits in sorted(set(deep[deep > 0].tolist())):
                some = made[deep == bits]
                low = 64 - PREFIX - bits
                mine = (some["fp"] >> np.uint64(low)) & np.uint64((1 << bits) - 1)
                for f in range(half + 1):
                    enough = some["left"] >= f
                    part, at = some[enough], mine[enough]
                    for mask in masks(bits, f) if len(part) else ():
                        moved = part.copy()
                        moved["left"] -= f
                        yield packed((part["key"].astype(np.int64) << bits) | (at ^ mask).astype(np.int64), low, moved)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(low: int, bucket: int, parts: list[bytes]) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(parts), ENTRY)
            bits = 64 - PREFIX - low
            head = x["key"].astype(np.uint64) << np.uint64(64 - PREFIX)
            if bits:
                head |= np.uint64(bucket & ((1 << bits) - 1)) << np.uint64(low)
            found = collide(x["fp"].astype(np.uint64), x["left"].astype(np.int64), head, low, radius)
            tree = forest(found) if len(found) else found
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(tree[:, j]).view(np.int64)) for j in (0, 1)], names=["u", "v"])

        now, parts = None, []
        for batch in batches:
            for low, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (low, bucket) != now and parts:
                    yield solved(*now, parts)
                    parts = []
                now = low, bucket
                parts.append(data)
        if parts:
            yield solved(*now, parts)

    spread = fps.mapInArrow(scatter, "low int, bucket long, entries binary")
    return spread.repartition(buckets, "low", "bucket").sortWithinPartitions("low", "bucket").mapInArrow(meet, "u long, v long")


def components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp) rows -> (fp, root, component_id, n, size): for each distinct fingerprint, the smallest fingerprint and the smallest doc_id that links can reach, its number of rows and its component's."""
    tasks = prints.sparkSession.sparkContext.defaultParallelism
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = cut(least.repartition(tasks))
    roots = connected_components(links(least.select("fp"), radius))
    # Fingerprints without a link are their own components; the others and their roots are the few that are summed up.
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    found = cut_few(least.join(members, "fp", "left"))
    tied = found.where("root is not null")
    whole = cut_few(tied.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"), F.count("*").alias("fps")))
    tied = attach(tied.select("fp", "n", "root"), whole, "root", least.count(), number="fps")
    alone = found.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), "n", F.col("n").alias("size"))
    return tied.select(*alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs."""
    prints = cut(fingerprints(docs, words_per_shingle))
    found = cut_few(components(prints, radius).select("fp", "component_id", "n"))
    return attach(prints, found, "fp", prints.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Keys up to this number are broadcast, 32 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def drop_near_duplicates(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """docs with one row of each component: that with the smallest non-null doc_id, of rows with that id the one whose key is smallest, of rows with that text too the one whose columns' hash is smallest.

    Only the keys of rows that go, or of which one stays, are joined to the
    texts, so that rows without a near-duplicate are not shuffled.
    """
    key = fresh("simhash_key", docs.columns)
    keyed = docs.withColumn(key, row_key(quoted("doc_id"), quoted("text")))
    prints = cut(fingerprints(keyed, words_per_shingle, keep=("doc_id", key)).select("doc_id", F.col(key).alias("k"), "fp"))
    roots = cut_few(components(prints, radius).where("size > 1").select("fp", "root", "n"))
    tied = cut_few(attach(prints, roots, "fp", prints.count()))
    kept = tied.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "k")).alias("least")).select(F.col("least.k").alias("k"))
    repeated = tied.groupBy("k").agg(F.count("*").alias("copies"))
    kept = kept.join(repeated, "k").select("k", "copies")
    gone = repeated.join(kept.where("copies = 1"), "k", "left_anti").select(F.col("k").alias(key))
    gone = cut_few(gone)
    out = keyed.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, key, "left_anti")
    again = cut_few(kept.where("copies > 1").select(F.col("k").alias(key)))
    one = keyed.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, key, "left_semi")
    place, salt = fresh("simhash_place", one.columns), fresh("simhash_salt", one.columns)
    order = F.xxhash64(*(quoted(c).cast("string") for c in docs.columns))
    one = one.withColumn(salt, F.pmod(order, F.lit(64)))
    for by in ((key, salt), (key,)):
        first = Window.partitionBy(*(quoted(c) for c in by)).orderBy(order)
        one = one.withColumn(place, F.row_number().over(first)).where(quoted(place) == 1)
    return out.drop(key).unionByName(one.drop(key, place, salt))
