"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the end of the file lists every frame's
compressed and raw size (the public seekable format), and an index maps record ids to a frame and an offset inside it.
One record is read by fetching and decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, rows_of, utf8

#: Raw bytes after which a frame, and an archive, is closed.
FRAME, ARCHIVE = 256 << 10, 64 << 20
# Fixed values of the seekable Zstandard format and of WARC 1.1.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, record_id string, page_id long, record_type string, frame_offset long, frame_size long, record_offset long, record_size long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder's URI, as the executors reach it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if ":/" in uri else f"file://{uri}"))


def record_uri(page: int | None, digest: str, copy: int = 0) -> str:
    """``copy`` numbers the rows that repeat a page id and payload."""
    return f"<urn:page:{'' if page is None else page}:{digest}:{copy}>"


def page_of(uri: str) -> int | None:
    found = re.match(r"<urn:page:(-?\d*):", uri)
    return int(found[1]) if found and found[1] else None


def warc_record(page: int | None, copy: int, url: str | None, payload: bytes, digest: str, response: int | None, revisit: bool) -> bytes:
    """One record: the whole HTTP response, or for a revisit its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page, digest, copy)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_uri(response, digest)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Frames (compressed, raw size) from the end of a file, which must hold the whole table."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the archive")
    return list(struct.iter_unpack("<II", tail[-9 - 8 * n : -9]))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        at = end + 4 + int(headers["Content-Length"])
        yield headers, data[end + 4 : at]
        at += 4


class _Writer:
    """One task's archives; each appears under its name at once, so a repeated attempt replaces it by the same bytes."""

    def __init__(self, root: str, part: int, attempt: int):
        self.fs, self.root = opened(root)
        self.uri, self.part, self.attempt, self.number = root, part, attempt, 0
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.out = None
        self.raw, self.waiting, self.frames, self.at = bytearray(), [], [], 0

    def add(self, row: tuple, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.name = f"part-{self.part:05d}-{self.number:04d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.root}/.{self.name}.{self.attempt}")
            self.frames, self.at = [], 0
        self.waiting.append((*row, len(self.raw), len(record)))
        self.raw += record
        if len(self.raw) >= FRAME:
            yield from self.frame()
        if sum(f[1] for f in self.frames) >= ARCHIVE:
            self.close()

    def frame(self) -> Iterator[tuple]:
        if not self.raw:
            return
        packed = self.zstd.compress(bytes(self.raw))
        self.out.write(packed)
        for record_id, page, kind, offset, length in self.waiting:
            yield (f"{self.uri}/{self.name}", record_id, page, kind, self.at, len(packed), offset, length)
        self.frames.append((len(packed), len(self.raw)))
        self.at += len(packed)
        self.raw, self.waiting = bytearray(), []

    def close(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.fs.move(f"{self.root}/.{self.name}.{self.attempt}", f"{self.root}/{self.name}")
            self.out, self.number = None, self.number + 1


def write_archives(pages: DataFrame, root: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row under the shared folder ``root`` and return the index; reading it writes the files.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page id is the response and
    the others revisit it.  Groups are found on digests alone, so a payload that a third of the pages share moves no
    text to one task; the texts are shuffled once, by page id and digest, and a second time only if rows repeat both.
    A null html is an empty payload; a null url is left out; a page without an id revisits a page that has one, and is
    a response where none has.  Rows that repeat id and payload are one response and revisits of it.  A record of any
    length is one frame's, so the longest text bounds a task's memory.  An empty table gives no rows and no file;
    other columns of ``pages`` are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    grouped = rows.groupBy("page_id", "digest").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    keys = Scratch(pages.sparkSession, "warc-keys").save(grouped)
    able = keys.filter(F.col("size") >= least)
    first = able.groupBy("digest").agg(F.max("page_id").alias("response"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    decided = able.join(first, "digest").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "response")
    joined = rows.join(decided, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p")
    if not keys.filter("n > 1").isEmpty():
        # Copies of a row are numbered where they lie, so all must lie in one task; whether the join brings them there is its choice.
        joined = joined.repartition("page_id", "digest")
    ordered = joined.sortWithinPartitions("page_id", "digest", "url").select("page_id", "url", "payload", "digest", F.col("d").isNotNull().alias("shared"), "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = _Writer(root, task.partitionId(), task.taskAttemptId())
        schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in INDEX.split(", "))])
        pack = lambda found: pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema)
        last, copy = None, 0
        for batch in rows_of(batches, 256):
            found: list[tuple] = []
            for page, url, payload, digest, shared, response in zip(*(c.to_pylist() for c in batch.columns)):
                copy = copy + 1 if (page, digest) == last else 0
                last = page, digest
                revisit = shared and (page != response or copy > 0)
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                record = warc_record(page, copy, url, payload, base32, response, revisit)
                found += writer.add((record_uri(page, base32, copy), page, "revisit" if revisit else "response"), record)
            if found:
                yield pack(found)
        if writer.out is not None:
            if found := list(writer.frame()):
                yield pack(found)
            writer.close()

    return ordered.mapInArrow(run, INDEX)


def _outcome(headers: dict[str, str], block: bytes) -> tuple:
    """A row of :data:`RECORDS`; the digest of a stored payload is computed anew and must agree."""
    at = block.index(b"\r\n\r\n") + 4
    size = int(re.search(rb"Content-Length: (\d+)", block[:at])[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response":
        payload = block[at:]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not agree with its header")
    refers = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(headers["WARC-Record-ID"]), size, digest, kind, refers


def archive_frames(uri: str) -> Iterator[bytes]:
    """Raw bytes of each frame of an archive, found through its seek table."""
    files, path = opened(uri)
    with files.open_input_file(path) as f:
        f.seek(f.size() - 9)
        n = struct.unpack("<I", f.read(4))[0]
        f.seek(f.size() - 9 - 8 * n)
        frames = read_seek_table(f.read(9 + 8 * n))
        zstd, at = zstandard.ZstdDecompressor(), 0
        for packed, raw in frames:
            f.seek(at)
            yield zstd.decompress(f.read(packed), max_output_size=raw)
            at += packed


def read_record(uri: str, frame_offset: int, frame_size: int, record_offset: int, record_size: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: one frame is read."""
    files, path = opened(uri)
    with files.open_input_file(path) as f:
        f.seek(frame_offset)
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(frame_size))
    return next(parse_records(raw[record_offset : record_offset + record_size]))


def read_archives(archives: DataFrame) -> DataFrame:
    """:data:`RECORDS` of every record of the archives named in the only column; one archive is one task's unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RECORDS.split(", "))])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for raw in archive_frames(uri):
                    found = [_outcome(h, b) for h, b in parse_records(raw)]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema)

    return archives.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back; an empty table gives no rows."""
    scratch = Scratch(pages.sparkSession, "warc")
    index = scratch.save(write_archives(pages, f"{scratch.root}/archives", least))
    archives = index.select("archive").distinct()
    n = max(1, archives.count())
    return read_archives(archives.repartitionByRange(min(n, 4096), "archive"))
