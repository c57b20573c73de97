"""Chat formatting by columnar byte assembly.

Template: each turn is "<turn>", the role, a newline, the text, "</turn>" and a
newline. In texts and roles a backslash is doubled and "<turn>" and "</turn>"
get one after "<"; a role's newlines become "\\\\n". So the output has those
control strings at turns only and can be read back exactly. The loss is on the
texts of assistant turns.

For a batch of rows, segment lengths, offsets and scatter indices come from
numpy, and headers and contents are copied into one buffer that becomes an
Arrow column. A conversation is emitted in parts of bounded size, in order, so
that one of any length needs no more memory; its turns do meet in one task, as
its text is one sequence.

Rows go by turn, nulls first; equal turns by role and text. A null role or text
is an empty one; a null conv_id is a conversation of its own. An empty table
has no output. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import quoted

OPEN, CLOSE = b"<turn>", b"</turn>\n"
CONTROL = re.compile(rb"<(?=/?turn>)")
TRAINED = "assistant"
#: Rows, and bytes of their texts, that are assembled at once; a part has no more, but for a single longer turn.
ROWS, BYTES = 1024, 4 << 20
#: Longer texts are copied as a whole instead of by indices, which take eight times their bytes.
WHOLE = 1 << 16
PART = "conv_id {0}, part long, formatted binary, turn_starts array<long>, loss array<struct<start:long,stop:long>>"


def escaped(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that lie one after another in data up to ends -> the same with control strings escaped."""
    raw = data.tobytes()
    slashes = np.flatnonzero(data == 92)
    starts = np.array([m.start() for m in CONTROL.finditer(raw)], np.int64) if b"turn>" in raw else np.empty(0, np.int64)
    if len(starts):
        # Not across two texts.
        own = np.searchsorted(ends, starts, "right")
        length = np.where(data[np.minimum(starts + 1, len(data) - 1)] == 47, 7, 6)
        starts = starts[starts + length <= ends[own]]
    after = np.sort(np.concatenate([slashes, starts]))
    if not len(after):
        return data, ends
    return np.insert(data, after + 1, 92), ends + np.searchsorted(after, ends)


def plain(data: bytes) -> bytes:
    """The text that escaped() made data of."""
    return re.sub(rb"\\(.)", rb"\1", data, flags=re.DOTALL) if b"\\" in data else data


def column(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
    """Copies text i of data to out[at[i]:]."""
    lengths = np.diff(ends, prepend=0)
    starts = ends - lengths
    short = lengths <= WHOLE
    for i in np.flatnonzero(~short).tolist():
        out[at[i] : at[i] + lengths[i]] = data[starts[i] : ends[i]]
    if short.all():
        out[np.arange(len(data)) + np.repeat(at - starts, lengths)] = data
    else:
        n = np.where(short, lengths, 0)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[within + np.repeat(at, n)] = data[within + np.repeat(starts, n)]


def assemble(roles: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes in one buffer; where each turn begins and ends; where its text begins and ends."""
    role, role_ends = escaped(*column([(r or "").encode() for r in roles]))
    if (role == 10).any():
        parts = [bytes(x).replace(b"\n", b"\\n") for x in np.split(role, role_ends[:-1])]
        role, role_ends = column(parts)
    text, text_ends = escaped(*column([t or b"" for t in texts]))
    role_len, text_len = np.diff(role_ends, prepend=0), np.diff(text_ends, prepend=0)
    turn_len = len(OPEN) + role_len + 1 + text_len + len(CLOSE)
    stops = np.cumsum(turn_len)
    starts = stops - turn_len
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
    for j, byte in enumerate(OPEN):
        out[starts + j] = byte
    role_at = starts + len(OPEN)
    text_at = role_at + role_len + 1
    out[text_at - 1] = 10
    for j, byte in enumerate(CLOSE):
        out[stops - len(CLOSE) + j] = byte
    scatter(out, role_at, role, role_ends)
    scatter(out, text_at, text, text_ends)
    return out, np.append(starts, stops[-1:]), text_at, text_at + text_len


def conversations(df: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order."""
    rows = df.select(quoted("conv_id").alias("conv_id"), quoted("turn").alias("turn"), F.coalesce(quoted("role").cast("string"), F.lit("")).alias("role"), F.coalesce(quoted("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def sliced(big: pa.RecordBatch, rows: int, octets: int) -> Iterator[pa.RecordBatch]:
    """big in pieces of at most so many rows and, but for a single longer text, so many bytes of text."""
    sizes = np.diff(np.frombuffer(big.column(3).buffers()[1], np.int32)[big.column(3).offset :][: big.num_rows + 1]).tolist() if big.num_rows else []
    at = 0
    while at < big.num_rows:
        stop, size = at + 1, sizes[at]
        while stop < big.num_rows and stop - at < rows and size + sizes[stop] <= octets:
            size += sizes[stop]
            stop += 1
        yield big.slice(at, stop - at)
        at = stop


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, part (from 0), formatted, turn_starts and loss (byte spans in the part) of all conversations, in order within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, now, part = False, None, 0
        for big in batches:
            for batch in sliced(big, ROWS, BYTES):
                ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                buffer, bounds, text_at, text_end = assemble(roles, batch.column(3).to_pylist())
                firsts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
                parts, spans, starts = [], [], []
                for a, b in zip(firsts, [*firsts[1:], len(ids)], strict=True):
                    part = part + 1 if began and ids[a] == now else 0
                    began, now = True, ids[a]
                    parts.append(part)
                    zero = bounds[a]
                    starts.append((bounds[a:b] - zero).tolist())
                    spans.append([{"start": int(text_at[i] - zero), "stop": int(text_end[i] - zero)} for i in range(a, b) if roles[i] == TRAINED])
                offsets = np.append(bounds[firsts], bounds[-1]).astype(np.int64)
                formatted = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(firsts)), pa.array(parts, pa.int64()), formatted, pa.array(starts, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    names=["conv_id", "part", "formatted", "turn_starts", "loss"],
                )

    rows = conversations(df)
    return rows.mapInArrow(run, PART.format(rows.schema["conv_id"].dataType.simpleString()))


def read_back(formatted: bytes, loss: list[dict]) -> Iterator[tuple[bytes, bytes, bytes | None]]:
    """Role, text and text under the loss mask (None where there is none) of each turn, from a part's bytes and mask alone."""
    spans = {x["start"]: x["stop"] for x in loss}
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a turn must begin here")
        middle = formatted.index(b"\n", at)
        end = formatted.index(CLOSE, middle)
        role = re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], formatted[at + len(OPEN) : middle], flags=re.DOTALL)
        mask = plain(formatted[middle + 1 : spans[middle + 1]]) if middle + 1 in spans else None
        yield role, plain(formatted[middle + 1 : end]), mask
        at = end + len(CLOSE)


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of format_conversations' output: what reading it back gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        def ended(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, part, data, loss in zip(*(batch.column(batch.schema.get_field_index(x)) for x in ("conv_id", "part", "formatted", "loss")), strict=True):
                if part.as_py() == 0:
                    if state:
                        done.append(ended(state))
                    state = [conv.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = data.as_py()
                state[5] += len(data.decode())
                for role, text, mask in read_back(data, loss.as_py()):
                    state[1] += 1
                    state[2].update(role + b"\n" + text + b"\n")
                    if mask is not None:
                        state[3] += len(mask.decode())
                        state[4].update(mask)
            if done:
                yield flush()
        if state:
            done.append(ended(state))
            yield flush()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
