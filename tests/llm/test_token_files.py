"""Simple-8b words against a plain reading of the format, files against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import documents, empty
from tokenizers import Tokenizer

from tessera.llm import token_files as T


def plain_decode(words, n):
    """One word after another."""
    out, words = [], [int(w) for w in words]
    while len(out) < n:
        word = words.pop(0)
        selector = word >> 60
        if selector == 0:
            out.append(words.pop(0))
            continue
        count, width = T.COUNTS[selector - 1], T.WIDTHS[selector - 1]
        out += [word >> k * width & (1 << width) - 1 for k in range(count)][: n - len(out)]
    assert not words
    return out


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=200), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_words(values, times):
    ids = np.array(values * times, dtype=np.uint64)
    words, sizes = T.encode_blocks(ids)
    at = 0
    for block, size in enumerate(sizes):
        part = ids[block * T.BLOCK : (block + 1) * T.BLOCK]
        assert plain_decode(words[at : at + size], len(part)) == part.tolist()
        at += size
    assert at == len(words)
    assert T.decode_words(words, sizes, T._block_ids(len(ids))).tolist() == ids.tolist()


def test_most_ids_a_word():
    words, _ = T.encode_blocks(np.array([1] * 60 + [0] * 60, dtype=np.uint64))
    assert [int(w) >> 60 for w in words] == [1, 1]
    words, _ = T.encode_blocks(np.array([2**63, 5], dtype=np.uint64))
    assert int(words[0]) == 0 and int(words[1]) == 2**63  # an escape and its id
    assert len(T.encode_blocks(np.full(3 * T.BLOCK, 50_000, np.uint64))[0]) == 3 * -(-T.BLOCK // 3)


def test_files_hold_the_library_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "LEAST", 20_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    files = T.write_token_files(docs, str(tmp_path / "files"), path, 0).cache()
    placed = [(r["file"], r["first"]) for r in T.placed_files(files).collect()]
    assert len(placed) > 3
    library = Tokenizer.from_file(path)
    left = {}
    for r in rows:
        ids = (*library.encode(r["text"] or "", add_special_tokens=False).ids, 0)
        left.setdefault(r["doc_id"], []).append(ids)
    order, total = [], 0
    for uri, first in placed:
        assert first == total
        with T.TokenFile(uri) as f:
            for k, doc in enumerate(f.docs):
                ids = f.document(k)
                left[doc].remove(tuple(ids.tolist()))
                order.append(doc)
                if len(ids) > 2500:  # a span inside a document, over block borders
                    a = int(f.starts[k])
                    assert f.read(a + 1000, a + 2100).tolist() == ids[1000:2100].tolist()
            total += f.ids
            assert list(f.checksums()) == [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(len(f.docs))]
    assert not any(left.values())
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    files.unpersist()


def test_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark)
    got = T.token_round_trip(docs, path).collect()
    library = Tokenizer.from_file(path)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], n := len(i := library.encode(r["text"] or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for r in docs.collect())
    assert sorted((-1 if g["doc_id"] is None else g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got) == want
    at = 0
    for g in sorted(got, key=lambda g: g["start"]):
        assert g["start"] == at
        at += g["n_tokens"]
    assert T.token_round_trip(empty(spark), path).collect() == []


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.s8b").write_bytes(b"nothing of the kind, but long enough")
    with pytest.raises(ValueError, match="no token file"):
        T.TokenFile(str(tmp_path / "x.s8b"))
