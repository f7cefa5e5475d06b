"""Token-id files in Simple-8b word-aligned coding.

A file holds the ids of its documents one after another, cut into blocks of 1,024.  Each block is a row of 64-bit words: the
top four bits select how many ids of which width the other sixty hold.  Selector 0 is an escape: the next word is one id of
61 bits or more, whose own top bits are therefore never zero, so that escapes are seen without reading in order.  The footer
holds the word offset of every block, and the id, length and null mark of every document, in the same coding; so any span is
read by fetching the blocks that it touches, and decoded by array operations.

    words | footer: blocks, documents, ids (3 x 8 bytes), block offsets, document ids, lengths, null marks | footer size | magic
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, give_back, rows_of, utf8
from tessera.llm.packing import encoder
from tessera.llm.warc import opened

# Fixed values of the format: ids per word and their width by selector (1 to 14), ids of a block, the last bytes of a file.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK, MAGIC = 1024, b"S8BWORDS"
#: Text bytes of a file in large inputs; small ones are cut into up to MOST files of LEAST bytes.
FILE, LEAST, MOST = 128 << 20, 4 << 20, 256
#: Ids that a writer encodes, or a reader decodes, at once.
_AT_ONCE = 1024 * BLOCK
FILES = "file string, part int, documents long, ids long, bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks (uint64) and the number of words of each; the last block may be short.

    For every place the selector is found that takes most of the ids ahead; then all blocks are walked together, one word a
    step, and the words of all places that were met are made at once, selector by selector.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK + COUNTS[0], np.uint64)
    padded[:n] = ids
    grid = padded[: blocks * BLOCK].reshape(blocks, BLOCK)
    most = int(grid.max()).bit_length()
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(len(COUNTS), 0, -1):
        count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
        if width >= most:
            choice[:] = selector
            continue
        # Ids that don't fit, up to each place: none lies ahead if the number is the same ``count`` places on.
        wide = np.zeros((blocks, BLOCK + count), np.int16)
        np.cumsum(grid >= np.uint64(1 << width), axis=1, dtype=np.int16, out=wide[:, 1 : BLOCK + 1])
        wide[:, BLOCK + 1 :] = wide[:, BLOCK : BLOCK + 1]
        choice[wide[:, count:] == wide[:, :BLOCK]] = selector
    choice = choice.reshape(-1)
    end = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    taken = np.array((1, *COUNTS))[choice]
    met = np.zeros(blocks * BLOCK, bool)
    live, at = end, np.arange(blocks) * BLOCK
    while len(at):
        met[at] = True
        at = at + taken[at]
        left = at < live
        at, live = at[left], live[left]
    places = np.flatnonzero(met)
    chosen = choice[places]
    sizes = 1 + (chosen == 0)
    slots = np.cumsum(sizes) - 1  # an escape's id stands in the last of its words
    words = np.zeros(int(sizes.sum()), np.uint64)
    words[slots[chosen == 0]] = padded[places[chosen == 0]]
    for selector in range(1, len(COUNTS) + 1):
        of = np.flatnonzero(chosen == selector)
        if len(of):
            count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
            word = np.full(len(of), selector << 60, np.uint64)
            last = end[places[of] // BLOCK]
            for k in range(count):
                index = places[of] + k
                word |= np.where(index < last, padded[index], np.uint64(0)) << np.uint64(k * width)
            words[slots[of]] = word
    return words, np.bincount(places // BLOCK, weights=sizes, minlength=blocks).astype(np.int64)


def decode_words(words: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids (uint64) of consecutive whole blocks: ``sizes`` words and ``ids`` ids each."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array((0, *COUNTS, 1))[selector]
    raw = np.flatnonzero(selector == 0) + 1
    counts[raw] = 1
    ends = np.cumsum(counts)
    last = np.cumsum(sizes) - 1
    # The last word of a block may hold fewer ids than its selector says.
    before = np.concatenate([[0], ends[last][:-1]])
    out = np.zeros(int(ends[-1]), np.uint64)
    is_raw = np.zeros(len(words), bool)
    is_raw[raw] = True
    out[ends[raw] - 1] = words[raw]
    for s in range(1, len(COUNTS) + 1):
        of = np.flatnonzero((selector == s) & ~is_raw)
        if len(of):
            count, width = COUNTS[s - 1], WIDTHS[s - 1]
            shifts = (np.arange(count) * width).astype(np.uint64)
            index = (ends[of] - count)[:, None] + np.arange(count)
            out[index] = (words[of][:, None] >> shifts) & np.uint64((1 << width) - 1)
    held = ends[last] - before
    return out[np.arange(len(out)) - np.repeat(before, held) < np.repeat(ids, held)]


def _packed(values: np.ndarray) -> bytes:
    """A list of numbers in the footer: how many, its words' sizes per block (32 bits each), its words."""
    words, sizes = encode_blocks(values.astype(np.uint64))
    return struct.pack("<QQ", len(values), len(words)) + sizes.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def _block_ids(n: int) -> np.ndarray:
    out = np.full(-(-n // BLOCK), BLOCK, np.int64)
    if n % BLOCK:
        out[-1] = n % BLOCK
    return out


def _unpacked(data: memoryview) -> tuple[np.ndarray, memoryview]:
    n, words = struct.unpack("<QQ", data[:16])
    blocks = -(-n // BLOCK)
    sizes = np.frombuffer(data[16 : 16 + 4 * blocks], "<u4").astype(np.int64)
    at = 16 + 4 * blocks
    values = np.frombuffer(data[at : at + 8 * words], "<u8").astype(np.uint64)
    return decode_words(values, sizes, _block_ids(n)), data[at + 8 * words :]


class FileWriter:
    """Writes one file under its name at once, so a repeated attempt replaces it by the same bytes."""

    def __init__(self, root: str, name: str, attempt: int):
        self.fs, self.root = opened(root)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.hidden = f"{self.root}/{name}", f"{self.root}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.hidden)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= _AT_ONCE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        cut = len(held) if last else len(held) // BLOCK * BLOCK
        for at in range(0, cut, _AT_ONCE):
            words, sizes = encode_blocks(held[at : min(cut, at + _AT_ONCE)])
            self.out.write(words.astype("<u8").tobytes())
            self.at += 8 * len(words)
            self.sizes.append(sizes)
        self.waiting, self.held = [held[cut:].copy()], len(held) - cut

    def close(self) -> int:
        """Write the footer and give the file its name; returns the file's bytes."""
        self._flush(True)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        null = np.array([d is None for d in self.docs], np.uint64)
        # Neighbouring ids differ little: differences, zigzag so that negative ones stay small.
        ids = np.diff(np.array([0 if d is None else d for d in self.docs], np.int64), prepend=np.int64(0))
        zigzag = ((ids << 1) ^ (ids >> 63)).view(np.uint64)
        footer = struct.pack("<QQQ", len(sizes), len(self.docs), self.ids)
        for values in (sizes, zigzag, np.array(self.lengths, np.uint64), null):
            footer += _packed(values)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        self.fs.move(self.hidden, self.name)
        return self.at + len(footer) + 16


class TokenFile:
    """A file opened for reading: ``docs`` (None for null), ``starts`` (ids before each document) and any span of ids."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        self.f = files.open_input_file(path)
        self.f.seek(self.f.size() - 16)
        size, magic = struct.unpack("<Q8s", self.f.read(16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.f.seek(self.f.size() - 16 - size)
        data = memoryview(self.f.read(size))
        self.blocks, n, self.ids = struct.unpack("<QQQ", data[:24])
        sizes, data = _unpacked(data[24:])
        zigzag, data = _unpacked(data)
        lengths, data = _unpacked(data)
        null, _ = _unpacked(data)
        ids = np.cumsum((zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64))
        self.docs = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        self.sizes = sizes.astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file; only the blocks that hold them are fetched."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first, last = start // BLOCK, -(-stop // BLOCK)
        self.f.seek(8 * int(self.offsets[first]))
        words = np.frombuffer(self.f.read(8 * int(self.offsets[last] - self.offsets[first])), "<u8")
        ids = np.minimum(BLOCK, self.ids - np.arange(first, last) * BLOCK)
        return decode_words(words, self.sizes[first:last], ids)[start - first * BLOCK : stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def checksums(self) -> Iterator[int]:
        """crc32 of every document's ids as little-endian unsigned 32-bit numbers, from one pass over the blocks."""
        held, at = np.zeros(0, "<u4"), 0  # ids from place ``at`` on
        for a, b in zip(self.starts.tolist(), self.starts[1:].tolist()):
            crc = 0
            while a < b:
                if a >= at + len(held):
                    at = a // BLOCK * BLOCK
                    held = self.read(at, min(self.ids, at + _AT_ONCE // 4)).astype("<u4")
                stop = min(b, at + len(held))
                crc = zlib.crc32(held[a - at : stop - at].tobytes(), crc)
                a = stop
            yield crc


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending order of id under ``root``; returns :data:`FILES`, and reading it writes them.

    Files follow each other in order of id.  Documents are dealt by ranges of id, text hash and row, so that an id which many
    rows share is spread; their order among each other is that of the hash.  Null ids come first.
    """
    size = docs.select(F.octet_length(utf8(text_col)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = max(1, -(-size // FILE), min(MOST, -(-size // LEAST)))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    key = [F.asc_nulls_first("id"), F.asc("hash"), F.asc("row")]
    dealt = rows.repartitionByRange(files, *key).sortWithinPartitions(*key).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, writer = task.partitionId(), None
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in rows_of(batches, 256):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    name = f"part-{part:06d}.s8b"
                    writer = FileWriter(root, name, task.taskAttemptId())
                writer.add(doc, np.frombuffer(encode(text.decode("utf-8", "replace")) + end, "<u4"))
        if writer is not None:
            found = [f"{root}/{name}"], [part], [len(writer.docs)], [writer.ids], [writer.close()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], [x.split()[0] for x in FILES.split(", ")])
        give_back()

    return dealt.mapInArrow(run, FILES)


def placed_files(files: DataFrame) -> DataFrame:
    """``file, first``: the number of ids in all files before.  There is one row for each task that wrote, which the driver
    tracks anyhow; their sums are made there."""
    rows, first = [], 0
    for r in files.select("part", "file", "ids").orderBy("part").collect():
        rows.append((r["file"], first))
        first += r["ids"]
    return files.sparkSession.createDataFrame(rows, "file string, first long")


def read_token_files(files: DataFrame) -> DataFrame:
    """:data:`RECORDS` of every document of the files (``file, first``), decoded from them; a file is one task's unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with TokenFile(uri) as f:
                    crc = pa.array(f.checksums(), pa.int64())
                    out = [pa.array(f.docs, pa.int64()), pa.array(f.starts[:-1] + first), pa.array(np.diff(f.starts)), crc]
                    yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in RECORDS.split(", ")])
                give_back()

    return files.mapInArrow(run, RECORDS)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read every document back: :data:`RECORDS`.

    Null and empty texts are the end id alone; texts of any length are encoded whole; repeated rows are a document each; null
    ids come first; other columns are not read; an empty table gives no rows and no file.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    files = scratch.save(write_token_files(docs, f"{scratch.root}/files", tokenizer, end_id, id_col, text_col))
    placed = placed_files(files)
    return read_token_files(placed.repartitionByRange(max(1, min(4096, files.count())), "file"))
