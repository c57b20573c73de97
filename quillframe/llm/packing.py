"""Best-fit packing of documents into sequences by the sum-of-squares rule.

A document is its token ids and an end id; only one longer than a sequence is
cut, into whole sequences and a rest. Each rest is placed where the sum over
all residual gaps of the squared count of open bins with that gap becomes
smallest, the longest rests first. What lies in bins that are not nearly full
is then placed anew by the same rule, as long as that takes fewer bins. Rests are dealt by a hash to groups of bounded size, which are packed
side by side; what each group leaves in bins that are not nearly full is dealt
to fewer groups and packed again, until one group is left. Rests are dealt by
their number, so a group has at most some tens of thousands of lengths whatever
the corpus and however alike its rows are, and no text moves.

A null text is packed as an empty one: the end id alone. Rows with equal ids
are told apart by their text and, if that is equal too, packed each. An empty
table has no pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillframe.llm.common import cut, quoted

#: Texts of these characters only are cut into words here as the tokenizer's own normalizer and splitter would: other white space, letters whose lower case has a mark, compatibility digits and whatever is beyond go through the tokenizer as a whole.
PLAIN = re.compile("[\t-\r -~¡-¬®-±´-¸º»¿-įı-ſ–—‘-”•…€]*")
WORDS = re.compile("[a-zªµºÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9a-zªµºÀ-ÖØ-öø-ɏ]+")
#: Words that a worker remembers the ids of: the first it meets, which the common ones are among. Others are learned anew for each batch.
REMEMBERED = 200_000
#: Rests that a group of the first round holds on average.
PER_GROUP = 20_000


class Remembered(dict):
    """word -> ids; a word that isn't known comes back as itself and is noted in new."""

    def __init__(self) -> None:
        self.new: set[str] = set()

    def __missing__(self, word: str) -> str:
        self.new.add(word)
        return word


class WordTokenizer:
    """Exactly the ids of a word-level byte-pair tokenizer file, a remembered word at a time."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known = Remembered()
        self.last = np.zeros(self.whole.get_vocab_size() + 1, bool)  # of ids that end a word
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.whole.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words):
            parts = [x.tobytes() for x in np.split(ids, ends[:-1])]
        else:
            parts = [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch(words, add_special_tokens=False)]
        self.known.update(zip(words, parts, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        known = self.known
        get = known.__getitem__
        found = [list(map(get, WORDS.findall(x.lower()))) if PLAIN.fullmatch(x) and "<|" not in x else None for x in texts]
        if known.new:
            new, room = sorted(known.new), max(0, REMEMBERED - len(known))
            known.new.clear()
            self.learn(new)
            found = [x if x is None else [y if y.__class__ is bytes else known[y] for y in x] for x in found]
            for word in new[room:]:
                del known[word]
        return [b"".join(x) if x is not None else np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for x, t in zip(found, texts, strict=True)]


@cache
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and, if asked for, ids) of every piece of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                encoded = [x + end for x in encode([x or "" for x in batch.column(1).to_pylist()])]
                rows, piece, start, length, crc, own = [], [], [], [], [], []
                for i, x in enumerate(encoded):
                    for k, a in enumerate(range(0, len(x), 4 * size)):
                        part = x[a : a + 4 * size]
                        rows.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            own.append(np.frombuffer(part, "<i4"))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int32()))] * ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    rows = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return rows.mapInArrow(run, schema.add("ids", ArrayType(IntegerType())) if ids else schema)


def sum_of_squares(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Each length's bin and offset, and each bin's gap: every length goes where the sum of the squared counts of open bins per gap grows least; of equal places, where the gap left is smallest."""
    count = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    bins, offsets = [], []
    closed = np.iinfo(np.int64).max
    for n in lengths:
        # From gap g to g - n: (c[g]-1)^2 - c[g]^2 + (c[g-n]+1)^2 - c[g-n]^2; a full bin isn't open. A new bin adds 2 c[size-n] + 1.
        growth = 2 * (count[: size + 1 - n] - count[n:]) + 2
        growth[0] = 1 - 2 * count[n]
        growth[count[n:] == 0] = closed
        growth[size - n] = 2 * count[size - n] + 1 if n < size else 0
        left = int(growth.argmin())
        if left == size - n:
            bins.append(len(gaps))
            offsets.append(0)
            gaps.append(left)
        else:
            at = open_bins[left + n].pop()
            count[left + n] -= 1
            bins.append(at)
            offsets.append(size - gaps[at])
            gaps[at] = left
        if left:
            open_bins[left].append(bins[-1])
            count[left] += 1
    return bins, offsets, gaps


def pack_group(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each length's bin and offset, and the bins' gaps: sum_of_squares with the longest first, and again of what is in bins with gaps over 1/256 that some length still fits while that takes fewer of them."""
    slack = max(size // 256, int(lengths.min(initial=size)) - 1)
    left = np.argsort(-lengths, kind="stable")
    bins, offsets, gaps = (np.array(x, np.int64) for x in sum_of_squares(lengths[left].tolist(), size))
    out, done = np.empty((2, len(lengths)), np.int64), []
    while True:
        full = gaps <= slack
        if full.any() and not full.all():
            loose = ~full[bins]
            again = [np.array(x, np.int64) for x in sum_of_squares(lengths[left[loose]].tolist(), size)]
            fewer = len(again[2]) < int((~full).sum())
        else:
            loose, fewer = np.zeros(len(left), bool), False
        settled = ~loose if fewer else np.ones(len(left), bool)
        kept = full if fewer else np.ones(len(gaps), bool)
        out[:, left[settled]] = (np.cumsum(kept) - 1 + sum(map(len, done)))[bins[settled]], offsets[settled]
        done.append(gaps[kept])
        if not fewer:
            return out[0], out[1], np.concatenate(done)
        left = left[loose]
        bins, offsets, gaps = again


def _round(rests: DataFrame, groups: int, level: int, size: int, slack: int) -> DataFrame:
    """rests (row, length) with sequence_id and offset; those of bins with gaps over slack with a null sequence_id."""
    dealt = rests.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int").alias("pack_group"))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        group = table.column("pack_group")[0].as_py()
        bins, offsets, gaps = pack_group(table.column("length").to_numpy(), size)
        loose = gaps[bins] > slack
        ids = bins + (np.int64(level) << 56) + (np.int64(group) << 32)
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(ids, mask=loose)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("pack_group").applyInArrow(solve, "row long, length long, sequence_id long, offset long")


def assign(found: DataFrame, size: int = 2048, per_group: int = PER_GROUP) -> DataFrame:
    """Pieces (with their length) with sequence_id and offset. Pieces are numbered once they are written; numbers and lengths alone are shuffled until all have a place."""
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    columns = [c for c in found.columns if c != "row"]
    full = found.where(F.col("length") == size).select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = found.where(F.col("length") < size).select("row", "length")
    groups, level, placed = max(1, -(-rests.count() // per_group)), 1, None
    while True:
        packed = cut(_round(rests, groups, level, size, size // 64 if groups > 1 else size))
        done = packed.where("sequence_id is not null").select("row", "sequence_id", "offset")
        placed = done if placed is None else placed.unionByName(done)
        if groups == 1:
            break
        rests = packed.where("sequence_id is null").select("row", "length")
        groups, level = min(groups - 1, max(1, -(-rests.count() // per_group))), level + 1
    return full.unionByName(found.where(F.col("length") < size).join(placed, "row").select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    return assign(pieces(docs, vocabulary, size, end_id), size)


def packed_ids(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """pack_documents with the pieces' ids: the packed corpus itself. Texts are encoded once; ids are written with their pieces and move only when all have a place."""
    return assign(pieces(docs, vocabulary, size, end_id, ids=True), size)
