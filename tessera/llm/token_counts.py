"""Exact token counts at every prefix by dynamic programming over the merges of a BPE vocabulary.

A sequence of BPE tokens is the encoding of its text exactly if each two neighbours, encoded alone, stay as they are.
So the encoding of a prefix of n symbols is that of a shorter prefix plus one token whose pair with the last token of
the shorter one is stable; there is one such token.  One pass over a word gives the count of every prefix, and sums
over words give the count at every position of a text: a table with one number a character answers how many tokens any
prefix has and where to cut for a budget, without a second encoding.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import rows_of, utf8

#: Entries of a worker's tables of counted chunks, and of words and token pairs, and the longest key that they keep, so
#: that they hold some 200 MB at most; a full table starts anew, which costs time and changes no result.
CHUNKS, CACHE, KEY = 400_000, 800_000, 64
#: Printable ASCII, where the library's normalizer and splitter need not be called.
_PLAIN = re.compile(rb"[!-~]*\Z")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Unicode's white space, which no token of such a tokenizer crosses.
_RUN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What the tokenizer must split like :data:`_PARTS`.
_PROBE = "it's WE'LL 12ab!?'re <don't>they've I'd'm x'y--#a1"


class PrefixCounter:
    """Counts for one tokenizer file (BPE with word ends), as the tokenizers library encodes, specials in texts included."""

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        if library.normalizer is None or library.pre_tokenizer is None:
            raise ValueError(f"{path} has no normalizer or splitter")
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain BPE model")
        if [w for w, _ in self._split(self._normalize(_PROBE))] != [w for run in _PROBE.lower().split() for w in _PARTS.findall(run)]:
            raise ValueError(f"{path} splits text in another way than is known here")
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self._halves: dict[str, tuple[str, str]] = {}
        self._made: dict[str, int] = {}
        for pair, rank in self.ranks.items():
            if self._made.setdefault(pair[0] + pair[1], rank) == rank:
                self._halves[pair[0] + pair[1]] = pair
        # Every beginning of a token; 1: is one inside a word, 2: is one at a word's end.
        self._known: dict[str, int] = {}
        for token in spec["model"]["vocab"]:
            ended = bool(self.end) and token.endswith(self.end)
            body = token[: -len(self.end)] if ended else token
            for i in range(1, len(body)):
                self._known.setdefault(body[:i], 0)
            self._known[body] = self._known.get(body, 0) | (2 if ended else 1)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self._stable: dict[tuple[str, str], bool] = {}
        self._words: dict[str, int] = {}
        self._chunks: dict[bytes, int] = {}

    def stable(self, left: str, right: str) -> bool:
        """Whether the two tokens, encoded together, stay as they are.

        Merges are undone from the latest: as long as neither token was there yet, their inner neighbours stood at
        the boundary, and a pair of those with an earlier merge would have been joined across it.  Of equal merges
        the left one comes first.
        """
        known = self._stable.get((left, right))
        if known is not None:
            return known
        made, halves, ranks = self._made, self._halves, self.ranks
        a, b, before = left, right, 1 << 30
        while True:
            known = ranks.get((a, b), 1 << 30) >= before
            if not known:
                break
            at, bt = made.get(a, -1), made.get(b, -1)
            if at < 0 and bt < 0:
                break
            if at > bt:
                before, a = at, halves[a][1]
            else:
                before, b = bt + 1, halves[b][0]
        if len(self._stable) >= CACHE:
            self._stable.clear()
        self._stable[left, right] = known
        return known

    def word_prefixes(self, word: str, ends: int | None = None) -> tuple[list[int], list[int]]:
        """Per number of symbols: the count of that prefix as the inside of a longer word, and as a whole word.

        ``ends``: only this prefix is counted as a whole word.
        """
        known, pairs, stable, end = self._known, self._stable, self.stable, self.end
        n = len(word)
        last: list[str] = [""] * (n + 1)
        inner, whole = [0] * (n + 1), [0] * (n + 1)
        for j in range(n):
            before = last[j]
            for i in range(j + 1, n + 1):
                token = word[j:i]
                kind = known.get(token)
                if kind is None:
                    break
                if kind & 1 and not inner[i] and (not j or pairs.get((before, token)) or stable(before, token)):
                    last[i] = token
                    inner[i] = inner[j] + 1
                if kind & 2 and (ends is None or i == ends) and not whole[i] and (not j or stable(before, token + end)):
                    whole[i] = inner[j] + 1
        return inner, (whole if end else inner)

    def _word(self, word: str) -> int:
        n = self._words.get(word)
        if n is None:
            n = self.word_prefixes(word, len(word))[1][-1]
            if len(word) <= KEY:
                if len(self._words) >= CACHE:
                    self._words.clear()
                self._words[word] = n
        return n

    def _piece(self, text: str) -> int:
        return sum(self._word(w) for w, _ in self._split(self._normalize(text))) if text else 0

    def chunk(self, raw: bytes) -> int:
        """Tokens of a stretch without ASCII white space.  Neither merges nor specials cross such white space."""
        n = self._chunks.get(raw)
        if n is None:
            text = raw.decode("utf-8", "replace")
            if self.special is not None and self.special.search(text):
                n = sum(i % 2 or self._piece(part) for i, part in enumerate(self.special.split(text)))
            elif _PLAIN.match(raw):
                n = sum(map(self._word, _PARTS.findall(text.lower())))
            else:
                n = self._piece(text)
            if len(raw) <= KEY:
                if len(self._chunks) >= CHUNKS:
                    self._chunks.clear()
                self._chunks[raw] = n
        return n

    def count(self, text: bytes) -> int:
        known, chunk = self._chunks.get, self.chunk
        return sum([n if (n := known(raw)) is not None else chunk(raw) for raw in text.split()])

    def _cuts(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a stretch without white space and specials."""
        norm = self._normalize(text)
        clean = norm == text.lower() and text.isascii()
        # Where normalized text ends for each prefix; -1 inside a letter with marks, which is normalized as one.
        place = list(range(1, len(text) + 1)) if clean else self._places(text, norm)
        if place is None:
            return [self._piece(text[:n]) for n in range(1, len(text) + 1)]
        words = [(a, b, word) for word, (a, b) in self._split(norm)]
        back = {0: 0} | {p: n for n, p in enumerate(place, 1) if p >= 0}
        out, k, before, sure = [], 0, 0, (0, 0)
        whole: list[int] = []
        for n, p in enumerate(place, 1):
            if p < 0:  # counted anew from the last word that starts at a whole letter
                out.append(sure[1] + self._piece(text[sure[0] : n]))
                continue
            while k < len(words) and words[k][1] < p:
                before += self._word(words[k][2])
                k, whole = k + 1, []
                if k < len(words) and words[k][0] in back:
                    sure = back[words[k][0]], before
            if k == len(words) or p <= words[k][0]:
                out.append(before)
                continue
            a, b, word = words[k]
            if word[0] == "'" and len(word) > 1 and norm[a + 1 : a + 2].isalpha() and p < b:  # half of a contraction is none
                out.append(before + self._piece(norm[a:p]))
                continue
            whole = whole or self.word_prefixes(word)[1]
            out.append(before + whole[p - a if len(word) == b - a else len(norm[a:p].encode())])
        return out

    def _places(self, text: str, norm: str) -> list[int] | None:
        """For the prefix of each length its length in ``norm``, or -1; null if letters are not normalized one by one."""
        starts = [i for i, c in enumerate(text) if not i or not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff")]
        made = [self._normalize(text[s:e]) for s, e in zip(starts, [*starts[1:], len(text)])]
        if "".join(made) != norm:
            return None
        out = [-1] * len(text)
        for end, p in zip([*starts[1:], len(text)], np.cumsum([len(m) for m in made]).tolist()):
            out[end - 1] = p
        return out

    def _run(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a stretch without white space."""
        if self.special is None or not self.special.search(text):
            return self._cuts(text)
        out: list[int] = []
        before, ordinary = 0, ""
        for i, part in enumerate(self.special.split(text)):
            if i % 2:  # a special is one token, a part of its string is text
                out += [before + self._piece(ordinary + part[:n]) for n in range(1, len(part))]
                before += self._piece(ordinary) + 1
                out.append(before)
            else:
                ordinary = part
                out += [before + n for n in self._cuts(part)] if part else []
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The exact token count of ``text[:n]`` for n from 0 to the text's length."""
        out = np.zeros(len(text) + 1, dtype=np.int32)
        before = at = 0
        for m in _RUN.finditer(text):
            out[at + 1 : m.start() + 1] = before
            counts = self._run(m[0])
            out[m.start() + 1 : m.end() + 1] = before + np.array(counts, dtype=np.int32)
            before, at = before + counts[-1], m.end()
        out[at + 1 :] = before
        return out


    def cut(self, text: str, budget: int) -> tuple[int, int]:
        """Characters and tokens of the longest prefix of at most ``budget`` tokens.

        Stretches are counted whole up to the one that goes beyond the budget, whose prefix table holds the place: all prefixes
        that end behind it have more tokens."""
        before = 0
        for m in _RUN.finditer(text):
            n = self.chunk(m[0].encode("utf-8", "surrogatepass"))
            if before + n > budget:
                table = np.array([0, *self._run(m[0])])
                at = cut_at(table, budget - before)
                return m.start() + at, before + int(table[at])
            before += n
        return len(text), before


def cut_at(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from its prefix table (a longer prefix may have fewer)."""
    fits = np.flatnonzero(np.asarray(counts) <= budget)
    return int(fits[-1]) if len(fits) else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit, kept_chars, kept_tokens`` for every row, from whole texts.

    The longest beginning of at most ``limit`` tokens has ``kept_chars`` code points and ``kept_tokens`` tokens, found by prefix
    counts and no second encoding; it is the whole text where that is not over the limit.

    ``tokenizer`` is the path of a tokenizers file.  Null and empty texts have 0 bytes and 0 tokens; repeated rows
    and null ids are kept; texts of any length are counted whole, with or without white space; other columns are not
    read; an empty table gives no rows.  One narrow pass without a shuffle.
    """
    names = [id_col, "n_bytes", "n_tokens", "kept_chars", "kept_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(tokenizer).count, counter(tokenizer).cut
        for batch in rows_of(batches, 512):
            made: list[list[int]] = [[], [], [], []]
            for raw in batch.column(1).to_pylist():
                text, n = raw.decode("utf-8", "replace"), count(raw)
                kept = (len(text), n) if n <= limit else cut(text, limit)
                for column, value in zip(made, (len(raw), n, *kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in made)], names)

    counted = docs.select(F.col(id_col).cast("long").alias(id_col), utf8(text_col).alias("_text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).select(*names[:3], "over_limit", *names[3:])


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, counts``: the exact token count of every prefix of the text, of 0, 1, 2, ... characters.

    Null and empty texts have the one count 0; repeated rows and null ids are kept; a table has a number for each
    character, so a very long text gives a long one; an empty table gives no rows.  One narrow pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(tokenizer).prefixes
        for batch in rows_of(batches, 64):
            tables = [prefixes(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, tables)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables)))], [id_col, "counts"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), utf8(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, counts array<int>")


def truncated(docs: DataFrame, tokenizer: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, n_tokens``: the longest beginning of each text that has at most ``budget`` tokens, and how many it has.

    Null texts become empty; repeated rows and null ids are kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = counter(tokenizer).cut
        for batch in rows_of(batches, 64):
            texts, counts = [], []
            for raw in batch.column(1).to_pylist():
                text = raw.decode("utf-8", "replace")
                n, tokens = cut(text, budget)
                texts.append(text[:n])
                counts.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], [id_col, "text", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), utf8(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, text string, n_tokens long")
