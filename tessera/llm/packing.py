"""Bounded-space online best-fit packing of tokenised documents into sequences of fixed length.

Each packing group keeps at most a fixed number of open bins.  An integer used as a bitset has bit f set when some open
bin has f tokens free; the lowest set bit at or above a piece's length is the tightest bin that takes it.  When a new
bin would exceed the number, the fullest open bin closes first.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import Scratch, give_back, rows_of, utf8

#: Entries of a worker's table of encoded units, and the longest key that it keeps, so that it holds some 50 MB at most;
#: it starts anew when full, which costs time and changes no result.
CACHE, KEY = 200_000, 64
#: Pieces that one packing group holds on average, and its open bins.
GROUP, OPEN = 65_536, 1024
#: Units beyond this length are left to the tokenizers library; texts go to the fast one whole if no run in them is as long.
LONG = 4096
_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond ASCII's, and what the library may count as such: units are then not independent.
_WIDE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
#: Such white space, and letters beyond old, settled blocks: on newer ones two libraries' Unicode tables could differ.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
_CHANGE = re.compile(r"[ \t-\r][^ \t-\r]|[^ \t-\r][ \t-\r]")
#: The pattern that splits text before byte-level merges (as the tokenizers library's ByteLevel does).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next free one from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitEncoder:
    """Ids of whole texts, exactly as the tokenizers library gives them.

    Texts of old, settled letters go whole to a faster one; others are put together from a table of encoded units.  A unit is a
    run of ASCII white space with the word after it; the splitting pattern never joins two units unless other white space
    stands between, and such texts go to the library whole.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(path, spec)
        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self._fast = tiktoken.Encoding("units", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        specials = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self._units: dict[str, bytes] = {}
        give_back()  # what the file's description took

    @cached_property
    def library(self) -> Tokenizer:
        """Read when a text needs it, as few do; it takes more memory than all else here but the table."""
        return Tokenizer.from_file(self.path)

    @staticmethod
    def _check(path: str, spec: dict) -> None:
        """Numbers must be merge ranks and the splitting pattern the built-in one; another file would give other ids."""
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE model")
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path} does not number its tokens by their merges")

    def _unit(self, unit: str) -> bytes:
        # Letters of old, settled blocks; on newer ones two libraries' Unicode tables could differ.  The fast library's
        # pattern can't take very long runs.
        ids = self._fast(unit) if len(unit) <= LONG and max(unit) < "\u0250" else self.library.encode(unit, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= KEY:
            if len(self._units) >= CACHE:
                self._units.clear()
            self._units[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        odd = _ODD.search(text) is not None
        if odd and _WIDE_SPACE.search(text) or self._special is not None and self._special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not odd and _short_runs(text):
            return array("I", self._fast(text)).tobytes()
        known, unit = self._units.get, self._unit
        return b"".join([known(u) or unit(u) for u in _UNIT.findall(text)])


def _short_runs(text: str) -> bool:
    """That no run of ASCII white space, or of other characters, has :data:`LONG` characters: it would fill one of the stretches
    of half that length into which the text is cut."""
    step = LONG // 2
    return all(_CHANGE.search(text, at, at + step) for at in range(0, len(text) - step + 1, step))


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one with what is left over."""
    first = total % size or min(total, size)
    return [(0, first), *((at, size) for at in range(first, total, size))]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` of every document's ids followed by ``end_id``."""
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in rows_of(batches, 512):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encode(text.decode("utf-8", "replace")) + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), utf8(text_col).alias("_text")).mapInArrow(run, schema)


class BestFit:
    """One group's bins; ``put`` returns the bin and the place in it."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.free = 0  # bit f: an open bin has f tokens free
        self.bins: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, f: int) -> int:
        own = self.bins[f]
        bin_ = own.pop()
        if not own:
            self.free ^= 1 << f
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            f = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(f)
        else:
            bin_, f = self.made, self.size
            self.made += 1
        left = f - length
        if left:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins.setdefault(left, []).append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.size - f


def pack(found: DataFrame, size: int, open_bins: int = OPEN, group: int = GROUP, id_col: str = "doc_id") -> DataFrame:
    """``found`` (a stored table of pieces) with ``sequence_id`` and ``offset``.

    Documents are dealt by a hash of their id into groups of about ``group`` pieces, packed independently in id order;
    only lengths travel, never ids.  A rerun gives the same packing.
    """
    groups = max(1, -(-found.count() // group))
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bins = None, None
        for batch in batches:
            seq, offset = [], []
            for g, length in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if g != at:
                    at, bins = g, BestFit(size, open_bins)
                bin_, place = bins.put(length)
                seq.append((g << 40) + bin_)
                offset.append(place)
            columns = [*(batch.column(i) for i in range(1, 6)), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Rows of one id (or without one) may be many: the piece's checksum spreads them over the groups.
    dealt = found.select(F.pmod(F.xxhash64(id_col, "ids_crc32", "start"), F.lit(groups)).alias("g"), id_col, "piece", "start", "length", "ids_crc32")
    order = ["g", F.xxhash64(id_col, "ids_crc32"), id_col, "piece", "ids_crc32", "length"]
    return dealt.repartition(groups, "g").sortWithinPartitions(*order).mapInArrow(run, schema)


def packed_sequences(
    docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, open_bins: int = OPEN, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's pieces with their place: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end id alone.  Repeated rows are packed each on its own; null ids stay
    null; other columns are not read; an empty table gives no rows.  Texts of any length are encoded whole; documents over
    ``size`` ids are cut, all others stay whole.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(pieces(docs, tokenizer, size, end_id, id_col, text_col)), size, open_bins, group, id_col)
