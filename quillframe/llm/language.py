"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's lower-cased UTF-8 bytes are cut at everything in ASCII but letters;
subwords are the 2 to 4 byte windows within a word and its borders. The mean
of their embeddings goes through a linear softmax. As the mean and the layer
are linear, prediction gathers one row of logits per subword.

A softmax over the learned languages is sure of texts in others too, so a text
is accepted if its score and the share of its subwords that were learned both
reach what all but a small share of right held-out texts reach. For the share,
each learned text is also held against all others.

Texts that are null or have no letter are "und" with score 0 and rejected. A
null or blank label is not learned. Ids and other columns are never inputs. If
no row can be learned from, every text is "und".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import fresh, quoted

SIZES = (2, 3, 4)
#: Bytes of text whose subwords are gathered at once.
SLICE = 1 << 19
SPACES = np.full(256, 32, np.uint8)
SPACES[97:123] = np.arange(97, 123)
SPACES[128:] = np.arange(128, 256)


@dataclass
class Settings:
    """buckets, dim: of the embedding table. sample: at most about so many labelled rows are learned from, evenly by language.

    Sampled texts are learned from whole. languages: more labels are an error. epochs, steps: at least so
    many passes and so many batches of 32. reject: share of right texts
    that calibration may turn away, half by score and half by known subwords.
    """

    buckets: int = 1 << 16
    dim: int = 16
    sample: int = 6000
    languages: int = 256
    epochs: int = 6
    steps: int = 1500
    rate: float = 1.0
    reject: float = 0.001
    seed: int = 11


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket; the last column is 1 where it was learned
    bias: np.ndarray
    temperature: float
    threshold: float  # of the score
    known: float  # least share of learned subwords

    def means(self, texts: list[str | None]) -> np.ndarray:
        sums, counts = subword_sums(texts, self.logits)
        return sums / np.maximum(counts, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether they are accepted."""
        means = self.means(texts)
        x = (means[:, :-1] + self.bias) / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        x /= x.sum(axis=1, keepdims=True)
        score = x.max(axis=1)
        return [self.languages[i] for i in x.argmax(axis=1)], score, (score >= self.threshold) & (means[:, -1] >= self.known)


def windows(data: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all windows of so many bytes, and which of them are subwords."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, bool)
    code = np.zeros(n, np.uint32)
    for j in range(size):
        code = (code << np.uint32(8)) | data[j : j + n]
    code = (code + np.uint32(size * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    letter = data != 32
    fine = letter[1 : 1 + n].copy() if size > 2 else letter[:n] | letter[1 : 1 + n]
    for j in range(2, size - 1):
        fine &= letter[j : j + n]
    return code >> np.uint32(32 - int(buckets).bit_length() + 1), fine


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with spaces between, and where each begins (and the last ends)."""
    parts = [b" %s " % (x or "").lower().encode("utf-8", "replace") for x in texts]
    ends = np.cumsum([0, *map(len, parts)])
    return SPACES[np.frombuffer(b"".join(parts), np.uint8)], ends


def subword_sums(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the sum of the rows of table at its subwords, and their number."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    data, ends = joined(texts)
    for start in range(0, len(data), SLICE):
        stop = min(start + SLICE, len(data))
        owners = np.arange(np.searchsorted(ends, start, "right") - 1, np.searchsorted(ends, stop, "left"))
        for size in SIZES:
            at, fine = windows(data[start : stop + size - 1], size, len(table))
            where = np.flatnonzero(fine)
            if not len(where):
                continue
            cuts = np.searchsorted(where, np.maximum(ends[owners] - start, 0))
            n = np.diff(np.append(cuts, len(where)))
            some = n > 0
            sums[owners[some]] += np.add.reduceat(table[at[where]], cuts[some], axis=0, dtype=np.float64)
            counts[owners[some]] += n[some]
    return sums, counts


def examples(texts: list[str], rng: np.random.Generator, some: int = 3) -> list[str]:
    """Of each text, itself and a few runs of 1 to 12 words, so that short texts are learned too."""
    out = []
    for text in texts:
        words = text.split()
        runs = [text]
        for _ in range(some):
            n = int(rng.integers(1, 13))
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            runs.append(" ".join(words[at : at + n]))
        out.append(runs)
    return out


def train(texts: list[str], labels: list[str], s: Settings) -> Model:
    """Stochastic gradient descent on nine tenths of the rows; temperature and rejection on the rest."""
    rng = np.random.default_rng(s.seed)
    names = sorted(set(labels))
    order = rng.permutation(len(texts))
    y_all = np.array([names.index(x) for x in labels])
    held = order[: len(order) // 10]
    learn = order[len(order) // 10 :]
    bags, ys, wholes = [], [], []
    for i in learn:
        for k, run in enumerate(examples([texts[i]], rng)[0]):
            data, _ = joined([run])
            found = [at[fine] for at, fine in (windows(data, n, s.buckets) for n in SIZES)]
            index, count = np.unique(np.concatenate(found), return_counts=True)
            if len(index):
                bags.append((index, (count / count.sum()).astype(np.float32)))
                ys.append(y_all[i])
                wholes += bags[-1:] if k == 0 else []
    table = (rng.standard_normal((s.buckets, s.dim)) / s.dim).astype(np.float32)
    layer = np.zeros((s.dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    ys = np.array(ys, np.int64)
    steps = 0
    each = max(1, len(bags) // 32)
    epochs = max(s.epochs, -(-s.steps // each))
    total = each * epochs
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(bags)), each):
            index = np.concatenate([bags[i][0] for i in batch]) if len(batch) else np.empty(0, np.int64)
            if not len(index):
                continue
            weight = np.concatenate([bags[i][1] for i in batch])[:, None]
            sizes = np.array([len(bags[i][0]) for i in batch])
            hidden = np.add.reduceat(table[index] * weight, np.cumsum(sizes) - sizes, axis=0)
            x = hidden @ layer + bias
            x = np.exp(x - x.max(axis=1, keepdims=True))
            x /= x.sum(axis=1, keepdims=True)
            x[np.arange(len(batch)), ys[batch]] -= 1
            rate = s.rate * (1 - steps / total)
            back = x @ layer.T
            layer -= rate / len(batch) * (hidden.T @ x)
            bias -= rate / len(batch) * x.sum(axis=0)
            # An embedding's gradient is small, as its share of a bag is; it takes a larger step.
            np.add.at(table, index, -rate * 4 * weight * np.repeat(back, sizes, axis=0))
            steps += 1
    # In how many texts each bucket is: a text's own does not make its subwords known when it is held against the others.
    number = np.zeros(s.buckets, np.int64)
    for index, _ in wholes:
        number[index] += 1
    without = [weight[number[index] > 1].sum(dtype=np.float64) for index, weight in bags]
    model = Model(names, np.hstack([table @ layer, (number > 0)[:, None]]).astype(np.float32), bias.astype(np.float64), 1.0, 0.0, 0.0)
    # So many short runs, which calibration would turn away most, that the share is a few of them, however few the texts are.
    some = max(3, int(4 / s.reject / max(1, len(held))))
    runs = [(run, y_all[i]) for i in held for run in examples([texts[i]], rng, some)[0] if has_letter(run)]
    if runs:
        means = model.means([run for run, _ in runs])
        x = means[:, :-1] + bias
        y = np.array([y for _, y in runs])

        def log_probability(t: float) -> np.ndarray:
            z = x / t
            return z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))

        model.temperature = float(min(np.geomspace(0.2, 5, 41), key=lambda t: -log_probability(t)[np.arange(len(y)), y].mean()))
        score = np.exp(log_probability(model.temperature))
        right = score.argmax(axis=1) == y
        if right.any():
            for name, values in (("threshold", score.max(axis=1)[right]), ("known", np.append(means[right, -1], without))):
                # A sum in another order may differ in the last digits.
                setattr(model, name, float(np.sort(values)[int(s.reject / 2 * len(values))]) - 1e-6)
    return model


def sample(rows: DataFrame, s: Settings) -> list[tuple[str, str]]:
    """(text, label) of a bounded, repeatable sample of labelled rows (label, id, text), evenly by label."""
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(s.languages + 1).collect()
    if not counts:
        return []
    if len(counts) > s.languages:
        raise ValueError(f"more than {s.languages} labels; a model of some would never predict the others")
    each = s.sample / len(counts)
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("label") == row["label"], F.lit(min(1.0, each / row["count"]))).otherwise(share)
    # By id and text, so that rows of one id are not all in or all out; the limit takes the smallest, whatever the order of partitions.
    number = F.xxhash64("id", "text", F.lit(s.seed))
    picked = rows.where(number.bitwiseAND(F.lit(0xFFFFF)) / F.lit(float(1 << 20)) < share).select("id", "text", "label")
    picked = picked.orderBy(F.xxhash64("id", "text", F.lit(s.seed + 1)), "id", "label").limit(int(1.5 * s.sample) + 100)
    return [(r["text"], r["label"]) for r in sorted(picked.collect(), key=lambda r: (r["id"] or "", r["text"], r["label"]))]


def fit(docs: DataFrame, learn: Column | None = None, settings: Settings | None = None, label: str = "lang") -> Model | None:
    """A model of docs' labelled rows for which learn holds; None if there is none."""
    s = settings or Settings()
    rows = docs.where(learn) if learn is not None else docs
    rows = rows.select(quoted(label).alias("label"), quoted("doc_id").cast("string").alias("id"), quoted("text").alias("text"))
    rows = rows.where(F.col("label").isNotNull() & (F.trim("label") != "") & F.col("text").rlike(r"\p{L}"))
    got = sample(rows, s)
    return train([t for t, _ in got], [x for _, x in got], s) if got else None


#: Rows, and characters, that are judged at once.
ROWS, CHARS = 512, 1 << 22


def judged(texts: list[str | None], found: np.ndarray, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and whether they are accepted, of texts of which found tells whether they have a letter."""
    if model is None:
        return ["und"] * len(found), np.zeros(len(found)), np.zeros(len(found), bool)
    langs, scores, accepted = [], [], []
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at] or "")
        while stop < len(texts) and size + len(texts[stop] or "") <= CHARS:
            size += len(texts[stop] or "")
            stop += 1
        x, y, z = model.predict(texts[at:stop])
        langs += x
        scores.append(y)
        accepted.append(z)
        at = stop
    return [x if f else "und" for x, f in zip(langs, found, strict=True)], np.where(found, np.concatenate(scores), 0.0), found & np.concatenate(accepted)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns keep with lang_pred, score and accepted, one row per row of docs."""
    names = [fresh(x, list(keep)) for x in ("lang_pred", "score", "accepted")]
    letter, whole = fresh("has_letter", list(keep)), fresh("whole_text", list(keep))
    rows = docs.select(*(quoted(k) for k in keep), F.coalesce(quoted(text).rlike(r"\p{L}"), F.lit(False)).alias(letter), quoted(text).alias(whole))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                found = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
                langs, scores, accepted = judged(batch.column(batch.num_columns - 1).to_pylist(), found, shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(langs, pa.string()), pa.array(scores), pa.array(accepted)], names=[*batch.schema.names[:-2], *names])

    schema = rows.drop(letter, whole).schema
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs without the rows that a model of their own labels rejects; the columns stay as they are. Without a labelled row there is no model to reject any: all rows stay.

    A row goes to Python and back once; the rejected ones don't come back.
    """
    model = fit(docs, settings=settings)
    if model is None:
        return docs
    letter = fresh("has_letter", docs.columns)
    rows = docs.withColumn(letter, F.coalesce(quoted("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                found = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                accepted = judged(batch.column(place).to_pylist(), found, shared.value)[2]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(accepted))

    return rows.mapInArrow(run, docs.schema)


def has_letter(text: str | None) -> bool:
    """What the operator calls a text with a letter, in Python."""
    return bool(text) and re.search(r"[^\W\d_]", text) is not None
