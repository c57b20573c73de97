"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some records,
then a seek table in a skippable frame and a footer, as in the seekable format
of Zstandard's contributions. An index maps record identifiers to bundle, frame
and offset within the frame, so one record is read by decompressing one frame.

Records with equal payloads (of at least min_revisit bytes): those of the
smallest id are responses, the others revisits that name its id, target and
date and carry HTTP headers only. Digests meet in the shuffle, payloads don't
unless the digests that repeat are too many to be broadcast. If rows repeat that id, all of them are responses. A null id is
never the smallest unless all are null; then all are responses. A null html is an
empty payload; a null url an empty target. An empty table has no bundles. Other
columns are ignored.

A task writes its bundles under names of its own and its index rows say which;
what a lost or doubled task leaves is in no index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import cut, quoted, shared_dir

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME, BUNDLE = 1 << 20, 64 << 20
#: Repeated digests are broadcast up to so many bytes of digests and targets; more are joined by a shuffle.
MOST_BROADCAST = 64 << 20
INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"
EOL = "\r\n"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as WARC has it after "sha1:"."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(bundle: str, number: int) -> str:
    """Of the record with this number in a bundle: no two records have one id, however alike their rows are."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{bundle}#{number}')}>"


def target(url: str) -> str:
    return quote(url, safe="%/:?#[]@!$&()*+,;=~'")


def record(ident: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, first_url: str | None, revisit: bool, date: str) -> bytes:
    """The record's bytes; a payload's size and digest are in a revisit's headers too."""
    body = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {len(payload)}{EOL}{EOL}".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}", f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {target(first_url or '')}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to}"]
    return (EOL.join(head) + EOL + EOL).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split(EOL)
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split(EOL)[1:]), payload


def filesystem(uri: str):  # noqa: ANN201
    """The file system and path of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:") if uri.startswith("file:/") else uri)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Sizes (compressed, whole) of the frames, and the footer, in a skippable frame."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int]]:
    """Start and compressed size of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    at, out = 0, []
    body = data[-9 - 8 * n : -9]
    for size, _ in struct.iter_unpack("<II", body):
        out.append((at, size))
        at += size
    return out


class Bundle:
    """One bundle being written."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.name = f"{uuid.uuid4().hex}.warc.zst"
        files, path = filesystem(folder)
        self.out = files.open_output_stream(f"{path.rstrip('/')}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.start, self.held, self.size, self.rows, self.done = 0, [], 0, [], []

    def next_id(self) -> str:
        return record_id(self.name, len(self.done) + len(self.rows))

    def add(self, page_id: int | None, ident: str, data: bytes) -> None:
        self.rows.append((page_id, ident, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self.end_frame()

    def end_frame(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.done += [(p, i, self.name, len(self.frames), self.start, len(packed), o, n) for p, i, o, n in self.rows]
            self.frames.append((len(packed), self.size))
            self.start += len(packed)
            self.held, self.size, self.rows = [], 0, []

    def close(self) -> list[tuple]:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.done


def index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])


def decided(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to and first_url of every row of pages."""
    p = pages.select(quoted("page_id").cast("long").alias("page_id"), F.coalesce(quoted("url").cast("string"), F.lit("")).alias("url"), F.coalesce(quoted("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("same", F.unhex(F.sha2("payload", 256)))
    long_enough = p.where(F.octet_length("payload") >= min_revisit)
    firsts = long_enough.groupBy("same").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("x"), F.count("*").alias("copies"))
    firsts = cut(firsts.where("copies > 1 and x.page_id is not null").select("same", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url")))
    size = firsts.agg(F.coalesce(F.sum(F.octet_length("first_url") + 64), F.lit(0))).first()[0]
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = p.join(F.broadcast(firsts) if size <= MOST_BROADCAST else firsts, "same", "left")
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("first_url"))


def write_bundles(pages: DataFrame, folder: str, min_revisit: int = 0, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Writes all rows of pages to bundles in folder, now; the index of their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for row in zip(*(batch.column(j) for j in range(6)), strict=True):
                page_id, url, payload, revisit, refers_to, first_url = (x.as_py() for x in row)
                bundle = bundle or Bundle(folder)
                ident = bundle.next_id()
                bundle.add(page_id, ident, record(ident, page_id, url, payload, refers_to, first_url, revisit, date))
                if bundle.start >= BUNDLE:
                    yield index_batch(bundle.close())
                    bundle = None
        if bundle:
            yield index_batch(bundle.close())

    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    return cut(decided(pages, min_revisit).mapInArrow(run, INDEX))


def read_bundles(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """The records of the index's bundles, read from the files: sizes and digests are those of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, path = filesystem(folder)
        unpack = zstandard.ZstdDecompressor()
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{path.rstrip('/')}/{name}") as f:
                    size = f.size()
                    f.seek(size - 9)
                    n = struct.unpack("<I", f.read(4))[0]
                    f.seek(size - 9 - 8 * n)
                    for start, packed in read_seek_table(f.read(8 * n + 9)):
                        f.seek(start)
                        data = unpack.decompressobj().decompress(f.read(packed))
                        rows, at = [], 0
                        while at < len(data):
                            body = data.index(b"\r\n\r\n", at) + 4
                            size_at = data.rindex(b"\r\nContent-Length: ", at, body) + 18
                            end = body + int(data[size_at : data.index(b"\r\n", size_at)]) + 4
                            rows.append(described(data[at:end]))
                            at = end
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    bundles = index.select("bundle").distinct()
    # As many tasks as bundles: the names are so few bytes that Spark would give them all to one.
    bundles = bundles.repartition(max(1, bundles.count()))
    return bundles.mapInArrow(run, RECORD)


def described(data: bytes) -> tuple:
    headers, http, payload = parse_record(data)
    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    own = named if revisit else digest(payload)
    return (None if page is None else int(page), headers["WARC-Target-URI"], headers["WARC-Type"], None if refers is None else int(refers), int(http["Content-Length"]) if revisit else len(payload), own, own == named)


def read_record(folder: str, row) -> tuple[dict[str, str], dict[str, str], bytes]:  # noqa: ANN001
    """One record by its index row: its frame alone is read and decompressed."""
    import zstandard

    files, path = filesystem(folder)
    with files.open_input_file(f"{path.rstrip('/')}/{row['bundle']}") as f:
        f.seek(row["frame_start"])
        data = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(row["frame_bytes"]))
    return parse_record(data[row["offset"] : row["offset"] + row["length"]])


def archive_pages(pages: DataFrame, folder: str | None = None, min_revisit: int = 0) -> DataFrame:
    """Writes pages to bundles in folder (by default a new one in the shared folder) and reads all of them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_bundles(spark, write_bundles(pages, folder, min_revisit), folder)
