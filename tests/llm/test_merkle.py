"""The manifest against a plain tree, over bucket and group borders."""

import hashlib
import zlib

import pytest
from tests.llm.fixtures import documents, empty

from tessera.llm import merkle as M

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for f in FIELDS:
        v = row[f]
        v = v + more if f == "n_chars" and v is not None else v
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(nodes):
    """Root and each node's siblings as (sibling or empty, whether the node is the right one)."""
    ways = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            other = at ^ 1
            ways[k].append((nodes[other] if other < len(nodes) else "", at & 1))
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], ways


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in order:
        langs[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs.append(tree([leaf(r) for r in langs[g]]))
    root, above = tree([s[0] for s in subs])
    out = []
    for g, (sub, ways), last in zip(order, subs, above):
        for r, way in zip(langs[g], ways):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = leaf(r, 1) if bad else leaf(r)
            for sibling, right in way + last:
                folded = h(sibling + folded if right else folded + sibling)
            out.append((r["doc_id"], leaf(r), sub, root, h("".join(s for s, _ in way + last)), folded, folded == root))
    return sorted(out, key=str)


def table(spark, langs, n):
    rows = [(i, f"text {i}", langs[i % len(langs)], "s", None if i % 11 == 0 else i, 1, 1, 1, 0.1, 1, 1) for i in range(n)]
    return spark.createDataFrame(rows, documents(spark, 1).schema)


@pytest.mark.parametrize("levels", [2, 12])
@pytest.mark.parametrize("langs, n", [(["en"], 1), (["en"], 9), (["en", "en", "en", None, "de"], 61), ([f"l{i}" for i in range(9)], 9)])
def test_equals_a_plain_tree(spark, levels, langs, n):
    docs = table(spark, langs, n)
    got = M.manifest(docs, FIELDS, "lang", M.tampered(FIELDS, "n_chars"), levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs.collect())


def test_awkward_rows(spark):
    docs = documents(spark, 60)
    got = sorted(map(tuple, M.manifest(docs, FIELDS, "lang", M.tampered(FIELDS, "n_chars"), levels=3).collect()), key=str)
    assert got == brute(docs.collect())
    assert {g[6] for g in got} == {True, False}
    assert M.manifest(empty(spark), FIELDS).collect() == []


def test_every_claim_is_its_leaf_by_default(spark):
    docs = table(spark, ["a", "b"], 40)
    assert all(r["verified"] for r in M.manifest(docs, FIELDS, levels=3).collect())
