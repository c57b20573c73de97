"""Characters of whole lines, measured where the line lies: one Arrow batch at a time, so that no row a character is made or shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines are taken together up to so many bytes of text; a longer one is taken alone.
BYTES = 1 << 19


class Chars:
    """The printable ASCII characters of lines, one after another: line has each one's line, i its place there, code what it is."""

    def __init__(self, lines: pa.RecordBatch | pa.Table, texts: pa.Array) -> None:
        self.lines, self.n_lines = lines, len(texts)
        offsets, data = bytes_of(texts)
        # Bytes of other characters are all above 0x7F.
        shown = (data >= 0x20) & (data <= 0x7E)
        self.line, self.code = np.repeat(np.arange(self.n_lines), np.diff(offsets))[shown], data[shown]
        self.n = np.bincount(self.line, minlength=self.n_lines)
        self.start = np.cumsum(self.n) - self.n
        self.i = np.arange(len(self.code)) - self.start[self.line]

    def of(self, name: str) -> np.ndarray:
        """A column of the lines, as numbers."""
        return self.lines.column(name).to_numpy(zero_copy_only=False)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and ends, and the bytes of all; of nulls none."""
    texts = texts.fill_null("").cast(pa.large_binary())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return at - at[0], (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8))


def parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many bytes, and one row at least."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def by_lines(df: DataFrame, keep: list[str], more: str, make: Callable[[Chars], tuple[np.ndarray, dict]]) -> DataFrame:
    """keep's columns of df (text and others) with those that make gives: the numbers of lines, and columns of the same length."""
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in df.select(*keep).dtypes), more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, np.diff(bytes_of(batch.column("text"))[0])):
                at, made = make(Chars(part, part.column("text")))
                own = [part.column(c).take(pa.array(at)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], names=[*keep, *made])

    return df.mapInArrow(run, schema)


def runs_of(line: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places and the lengths of runs of one value in one line."""
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(line) != 0) | (value[1:] != value[:-1])])
    return first, np.diff(np.r_[first, len(line)])


def owners(line: np.ndarray, visible: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """owner (-1: none) as it is for visible characters; a blank one gets its neighbours' if the nearest visible ones before and after agree."""
    k = len(line)
    at = np.arange(k)
    before = np.maximum.accumulate(np.where(visible, at, -1)) if k else at
    after = np.minimum.accumulate(np.where(visible, at, k)[::-1])[::-1] if k else at
    b, a = np.maximum(before, 0), np.minimum(after, k - 1)
    both = (before >= 0) & (after < k) & (line[b] == line) & (line[a] == line) if k else np.zeros(0, bool)
    return np.where(visible, owner, np.where(both & (owner[b] == owner[a]), owner[b], -1)) if k else owner


def owned_spans(c: Chars, visible: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, dict]:
    """Of each owner in a line its number, of characters and of blank ones, and where they begin and stop."""
    own = owners(c.line, visible, owner)
    held = own >= 0
    line, own, i, blank = c.line[held], own[held], c.i[held], ~visible[held]
    # An owner's characters need not lie together.
    order = np.lexsort((own, line)) if np.any((np.diff(line) == 0) & (np.diff(own) < 0)) else slice(None)
    line, own, i, blank = line[order], own[order], i[order], blank[order]
    first, n = runs_of(line, own)
    if not len(first):
        return first, {"id": first, "n": n, "blanks": n, "start": first, "stop": first}
    made = {"id": own[first], "n": n, "blanks": np.add.reduceat(blank.astype(np.int64), first), "start": np.minimum.reduceat(i, first), "stop": np.maximum.reduceat(i, first) + 1}
    return line[first], made


def counted(line: np.ndarray, value: np.ndarray, n_lines: int) -> pa.Array:
    """Each line's values and how often it has them, as a list."""
    order = np.lexsort((value, line))
    line, value = line[order], value[order]
    first, n = runs_of(line, value)
    ends = np.searchsorted(line[first], np.arange(n_lines + 1))
    entries = pa.StructArray.from_arrays([pa.array(value[first].astype(float)), pa.array(n)], ["v", "n"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)


def code_rows(c: Chars, code: np.ndarray, x0: np.ndarray, x1: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict]:
    """Rows of code without the small number they begin with: what is shown, where it begins, the steps between visible neighbours, and the widths of characters if there are none."""
    blank, digit = code == ord(" "), (code >= ord("0")) & (code <= ord("9"))
    big, first = np.zeros(c.n_lines), np.full(c.n_lines, len(code) + 1)
    plain = ~blank & ~digit
    np.maximum.at(big, c.line[plain], size[plain])
    number = blank | (digit & (size * 100 < 85 * big[c.line]))
    np.minimum.at(first, c.line[~number], c.i[~number])
    held = c.i >= first[c.line]
    line, code, blank, x0, x1 = c.line[held], code[held], blank[held], x0[held], x1[held]
    step = (line[1:] == line[:-1]) & ~blank[1:] & ~blank[:-1] & (x0[1:] > x0[:-1])
    steps = counted(line[1:][step], (x0[1:] - x0[:-1])[step], c.n_lines)
    has = np.bincount(line[1:][step], minlength=c.n_lines) > 0
    lone = ~blank & ~has[line]
    widths = counted(line[lone], (x1 - x0)[lone], c.n_lines)
    n = np.bincount(line, minlength=c.n_lines)
    at = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[at]
    shown = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.r_[begin, len(code)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.string())
    return at, {"shown": shown, "x0": x0[begin].astype(float), "steps": steps.take(pa.array(at)), "widths": widths.take(pa.array(at))}


def weighted_median(entries: Column) -> Column:
    """The median of values (v) that occur n times each; null of none."""
    whole = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    none = F.lit(None).cast("double")
    zero = F.struct(F.lit(0).cast("long").alias("k"), none.alias("low"), none.alias("high"), whole.alias("n"))

    def step(a: Column, e: Column) -> Column:
        k, n = a["k"] + e["n"], a["n"]
        reached = lambda name, place: F.coalesce(a[name], F.when(2 * k > place, e["v"])).alias(name)
        return F.struct(k.alias("k"), reached("low", n - 1 - (n + 1) % 2), reached("high", n - n % 2), n.alias("n"))

    return F.aggregate(F.array_sort(entries), zero, step, lambda a: (a["low"] + a["high"]) / 2)


def reindented(rows: DataFrame, block: list[str]) -> DataFrame:
    """(block, text) of rows as code_rows makes them: each begins with as many blanks as its indent has widths of a character."""
    g = rows.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("row", "x0", "shown"))).alias("rows"), F.min("x0").alias("left"), F.flatten(F.collect_list("steps")).alias("steps"), F.flatten(F.collect_list("widths")).alias("widths"))
    g = g.select(*block, "rows", "left", F.coalesce(weighted_median(F.col("steps")), weighted_median(F.col("widths"))).alias("width"))
    unit = F.when(F.col("width") > 0, F.col("width")).otherwise(1.0)
    line = lambda r: F.concat(F.repeat(F.lit(" "), F.bround((r["x0"] - F.col("left")) / unit, 0).cast("int")), r["shown"])
    return g.select(*block, F.array_join(F.transform("rows", line), "\n").alias("text"))


def spread(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number, and what lies in it, one after another."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner] + begins[owner]


def listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How many structs the lists of a column have, and their fields one after another."""
    x = batch.column(name)
    fields = x.flatten()
    names = [x.type.value_type.field(k).name for k in range(x.type.value_type.num_fields)]
    return x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), dict(zip(names, fields.flatten(), strict=True))


def rows_of(batch: pa.RecordBatch, name: str, fields: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The structs of each list of a column, as tuples."""
    counts, values = listed(batch, name)
    every = zip(*(values[c].to_pylist() for c in fields), strict=True)
    return (list(islice(every, n)) for n in counts.tolist())


def region_elements(pages: DataFrame, page: list[str], boxes: Callable[[Chars], dict[str, np.ndarray]], tolerance: float = 5.0) -> DataFrame:
    """(page, region, place, label, box, text) of pages with lines (ord, text) in order and regions (region, kind, top, bottom, column, middle, label) in order: what composites.true_elements makes of characters that are rows. boxes gives characters' baseline, x0, y0, x1 and y1."""
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in pages.select(*page).dtypes), "region long, place long, label string, x0 double, y0 double, x1 double, y1 double, text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lines = listed(batch, "lines")
            ends = np.r_[0, np.cumsum(n)]
            sizes = bytes_of(lines["text"])[0][ends]
            for part in parts(batch, np.diff(sizes)):
                yield elements_of(part, page, boxes, tolerance)

    return pages.mapInArrow(run, schema)


def elements_of(part: pa.RecordBatch, page: list[str], boxes: Callable[[Chars], dict[str, np.ndarray]], tolerance: float) -> pa.RecordBatch:
    n_lines, lines = listed(part, "lines")
    n_regions, own = listed(part, "regions")
    c = Chars(pa.RecordBatch.from_arrays([lines["ord"]], ["ord"]), lines["text"])
    at = {k: np.asarray(v, dtype=float) for k, v in boxes(c).items()}
    number = lambda name: own[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
    top, bottom, column, middle = number("top") - tolerance, number("bottom") + tolerance, number("column"), number("middle")
    kind = own["kind"].to_numpy(zero_copy_only=False)
    first = np.isin(kind.astype(str), ["hd", "pn", "wide"])
    of_page = np.repeat(np.arange(len(n_regions)), n_regions)
    # Regions meet the lines of their page whose baselines may be in their bands, then the characters of those.
    low, high = np.full(c.n_lines, np.inf), np.full(c.n_lines, -np.inf)
    np.minimum.at(low, c.line, at["baseline"])
    np.maximum.at(high, c.line, at["baseline"])
    r, line = spread(n_lines[of_page], (np.cumsum(n_lines) - n_lines)[of_page])
    near = (high[line] >= top[r]) & (low[line] <= bottom[r])
    r, line = r[near], line[near]
    k, g = spread(c.n[line], c.start[line])
    r = r[k]
    side = (at["x0"][g] + at["x1"][g]) / 2 >= middle[r]
    inside = (at["baseline"][g] >= top[r]) & (at["baseline"][g] <= bottom[r]) & (np.isnan(column[r]) | (side == column[r]))
    r, g = r[inside], g[inside]
    taken = np.zeros(len(c.code), bool)
    taken[g[first[r]]] = True
    kept = first[r] | ~taken[g]
    r, g = r[kept], g[kept]
    code, base = c.code[g], at["baseline"][g]
    visible = code != ord(" ")
    data, texts, found = code.tobytes(), [], []
    starts = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.abs(np.diff(base)) > tolerance)]) if len(r) else np.zeros(0, np.int64)
    for region, a, b in zip(r[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(r)].astype(int).tolist(), strict=True):
        if not found or found[-1] != region:
            found.append(region)
            texts.append([])
        texts[-1].append(data[a:b].decode("ascii").strip(" "))
    found = np.array(found, dtype=np.int64)
    rows, seen = r[visible], np.zeros(len(of_page), bool)
    seen[rows] = True
    ends = {name: np.full(len(of_page), np.inf if name in ("x0", "y0") else -np.inf) for name in ("x0", "y0", "x1", "y1")}
    for name, end in ends.items():
        (np.minimum if name in ("x0", "y0") else np.maximum).at(end, rows, at[name][g][visible])
    shown = seen[found]
    texts = ["\n".join(t) for t, s in zip(texts, shown, strict=True) if s]
    found = found[shown]
    region = own["region"].cast(pa.int64()).to_numpy(zero_copy_only=False)[found]
    order = np.lexsort((region, np.select([kind[found] == "hd", kind[found] == "pn"], [0, 2], 1), of_page[found]))
    pages = of_page[found][order]
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found)) - (np.searchsorted(pages, pages) if len(pages) else 0) + 1
    made = {"region": pa.array(region), "place": pa.array(place), "label": own["label"].take(pa.array(found)), **{k: pa.array(v[found]) for k, v in ends.items()}, "text": pa.array(texts, pa.string())}
    keys = [part.column(name).take(pa.array(of_page[found])) for name in page]
    return pa.RecordBatch.from_arrays([*keys, *made.values()], names=[*page, *made])


def short_runs(c: Chars, flag: np.ndarray, most: int) -> tuple[np.ndarray, dict]:
    """Where runs of at most so many flagged characters begin, and how many they are."""
    first, n = runs_of(c.line, flag)
    kept = flag[first] & (n <= most)
    return c.line[first[kept]], {"start": c.i[first[kept]], "n": n[kept]}


def letters(code: np.ndarray) -> np.ndarray:
    return ((code | 32) >= ord("a")) & ((code | 32) <= ord("z"))


def large_medians(c: Chars, size: np.ndarray, value: np.ndarray, share: float) -> tuple[np.ndarray, dict]:
    """The median of each line's values over the characters that are nearly as large as its largest."""
    biggest = np.zeros(c.n_lines)
    np.maximum.at(biggest, c.line, size)
    held = size >= share * biggest[c.line]
    line, value = c.line[held], value[held]
    value = value[np.lexsort((value, line))]
    n = np.bincount(line, minlength=c.n_lines)
    at = np.flatnonzero(n)
    begin, n = (np.cumsum(n) - n)[at], n[at]
    return at, {"baseline": (value[begin + (n - 1) // 2] + value[begin + n // 2]) / 2}


def groups_of(lines: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """A number for each line, the same for the same values of the columns; nulls are a value."""
    number = np.zeros(lines.num_rows, np.int64)
    for name in names:
        own = lines.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        number = np.unique(number * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return number


def last_places(c: Chars, group: np.ndarray, order: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, code, i) of the last of each group's characters of a code among those held, by the line's order and the place there."""
    # One sorted number a character: its line and code, then its place.
    key = np.sort(((c.line[held] << 7 | c.code[held]) << 32) | c.i[held])
    key = key[np.flatnonzero(np.diff(key >> 32, append=-1))] if len(key) else key
    line, code, i = key >> 39, (key >> 32) & 127, key & 0xFFFFFFFF
    by = np.lexsort((i, order[line], code, group[line]))
    line, code, i = line[by], code[by], i[by]
    last = np.flatnonzero(np.diff(group[line] << 7 | code, append=-1)) if len(line) else line
    return line[last], code[last], i[last]
