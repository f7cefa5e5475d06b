import random
import time
from itertools import combinations

import numpy as np
import pytest

from tessera.llm.common import Scratch
from tessera.llm.components import connected_components
from tessera.llm import simhash as module
from tessera.llm.simhash import Sketches, bucket_edges, covering_masks, fingerprint, hot_buckets, in_sample, local_roots, simhash_groups, similar_roots, sized_buckets, sketch, verified_groups, within

from .fixtures import DOCS, components, documents, empty, prose, shingle_set, simhash


def test_fingerprint_like_brute_force():
    rng = random.Random(3)
    for text in ["", " \n", "One", "a b c", "a b c d", "A B C D", "x y z", "ä Ö ü \x0b w", *(prose(rng, n) for n in (5, 50, 400))]:
        assert fingerprint(text.encode(), 4) % 2**64 == simhash(text), text


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_the_radius(bits):
    masks = covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(bits)
    for _ in range(3000):
        flipped = sum(1 << i for i in rng.sample(range(64), bits))
        assert any(not flipped & m for m in masks)


@pytest.mark.parametrize("block", [3, 65_536])
def test_groups_like_brute_force(spark, block):
    docs = documents(spark)
    rows = [(r["doc_id"], simhash(r["text"])) for r in docs.select("doc_id", "text").collect()]
    got = {(r["doc_id"], r["f0"] % 2**64): r["component_id"] for r in simhash_groups(docs, block=block).collect()}
    root = components(len(rows), ((i, j) for i, j in combinations(range(len(rows)), 2) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 or rows[i][0] is not None and rows[i][0] == rows[j][0]))
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        assert got[row] == (min(ids) if ids else None)


def test_local_search_like_brute_force():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**20, size=(200, 1)).astype(np.uint64)
    nodes = rng.permutation(1000)[:200]
    root = components(200, ((i, j) for i, j in combinations(range(200), 2) if int(prints[i, 0] ^ prints[j, 0]).bit_count() <= 3))
    want = [min(nodes[j] for j in range(200) if root[j] == root[i]) for i in range(200)]
    assert local_roots(prints, nodes, 3).tolist() == want


def test_similar_sets_like_brute_force():
    rng = random.Random(4)
    base = [set(rng.sample(range(500), 60)) for _ in range(10)]
    sets = [s | set(rng.sample(range(500, 900), rng.randrange(30))) for s in base for _ in range(4)]
    link = [(i, j) for i, j in combinations(range(40), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = similar_roots([np.array(sorted(s), dtype=np.uint64) for s in sets], np.arange(40), 0.8).tolist()
    assert got == components(40, link)


@pytest.mark.parametrize("shingles", [400, 2_000_000])
def test_verified_groups_like_brute_force(spark, shingles):
    """Light edits of long texts are found, heavy ones and other texts stay apart, whatever the blocks."""
    rng = random.Random(9)
    rows = []
    for i in range(12):
        words = prose(rng, 300).split()
        rows.append((len(rows), " ".join(words)))
        for edits in (0, 1, 2, 3, 60):
            other = list(words)
            for at in rng.sample(range(300), edits):
                other[at] = "edit"
            rows.append((len(rows), " ".join(other)))
    sets = [shingle_set(t) for _, t in rows]
    root = components(len(rows), ((i, j) for i, j in combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in verified_groups(docs, shingles=shingles).collect()}
    assert [got[i] for i in range(len(rows))] == root


def test_equal_fingerprints_do_not_make_copies(spark):
    """One long line repeated outweighs all else in a fingerprint; the texts' own words still keep them apart."""
    rng = random.Random(5)
    line = " ".join(f"l{i}" for i in range(15))
    texts = [" ".join([line] * 150) + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(100)) for _ in range(3)]
    assert (fingerprint(texts[0].encode(), 5) ^ fingerprint(texts[1].encode(), 5)).bit_count() <= 4
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[1])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in verified_groups(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1}


def test_repeated_lines_and_short_texts_are_found(spark):
    """Pairs at the similarity meet however short they are and however often one of them repeats a line."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for _ in range(4):  # the same words, one text with a line of 12 words repeated 60 times
        own = [word() for _ in range(304)]
        texts += [" ".join(own), " ".join(own + [f"l{len(texts)}_{i}" for i in range(12)] * 60)]
    for n in (8, 9, 15, 40):
        for _ in range(100):  # n shingles against those and as many more as the similarity bears
            own = [word() for _ in range(n + 4)]
            texts += [" ".join(own), " ".join(own + [word() for _ in range(n // 4)])]
    texts += ["a b c d e", "", " ", "b c d e f"]
    sets = [shingle_set(t) for t in texts]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {p for at in index.values() for p in combinations(at, 2)} | {(len(texts) - 3, len(texts) - 2)}
    root = components(len(texts), (p for p in pairs if sets[p[0]] == sets[p[1]] or len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in verified_groups(docs, block=3).collect()}
    assert len(set(root)) == 407 and [got[i] for i in range(len(texts))] == root


@pytest.mark.parametrize("block", [16, 8192])
def test_crowds_of_near_copies_and_of_shared_passages(spark, block):
    """More texts share their first shingles than give pairs: near copies are found by sketches, a passage alone links nothing."""
    rng = random.Random(11)
    base, passage = prose(rng, 400).split(), prose(rng, 70)
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rng.sample(range(400), rng.randrange(0, 12)):
            words[at] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, rng.randrange(100, 1500))} {passage}" for _ in range(90)]
    sets = [shingle_set(t) for t in texts]
    root = components(len(texts), ((i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in verified_groups(docs, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) < 130


def test_sketches_never_part_what_is_similar():
    rng = random.Random(12)
    sketches = Sketches(0.8)
    parted = 0
    for _ in range(3000):
        n = rng.choice([1, 3, 9, 40, 150, 400])
        base = [rng.randrange(2**64) for _ in range(n)]
        x, y = set(base), set(base) - set(rng.sample(base, rng.randrange(0, n // 4 + 1))) | {rng.randrange(2**64) for _ in range(rng.randrange(0, n // 4 + 1))}
        if not y:
            continue
        a, b = (sketch(np.array(sorted(z), dtype=np.uint64)) for z in (x, y))
        may = sketches.may_reach(int.from_bytes(a, "little"), 8 * len(a), len(x), int.from_bytes(b, "little"), 8 * len(b), len(y))
        similar = len(x & y) >= 0.8 * len(x | y)
        assert may or not similar
        parted += not may
    assert parted > 500


def test_matrices_of_sketches_like_pairs_of_numbers():
    """Groups found with matrices are those of the pairwise rule, with sketches of every length and empty sets."""
    rng = random.Random(13)
    sketches = Sketches(0.8)
    for _ in range(30):
        sets = []
        for _ in range(60):
            if sets and rng.random() < 0.6:
                base = sorted(rng.choice(sets))
                sets.append(set(base) - set(rng.sample(base, rng.randrange(0, len(base) // 8 + 1))) | {rng.randrange(2**64) for _ in range(rng.randrange(0, len(base) // 8 + 1))})
            else:
                sets.append({rng.randrange(2**64) for _ in range(rng.choice([0, 1, 2, 9, 60, 300, 1200]))})
        nodes = rng.sample(range(1000), len(sets))
        own = [(n, sketch(np.array(sorted(x), dtype=np.uint64)), len(x)) for n, x in zip(nodes, sets)]
        number = lambda b: (int.from_bytes(b, "little"), 8 * len(b))
        near = [(i, j) for i, j in combinations(range(len(own)), 2) if sketches.may_reach(*number(own[i][1]), own[i][2], *number(own[j][1]), own[j][2])]
        group = components(len(own), near)
        least = {g: min(n for n, h in zip(nodes, group) if h == g) for g in group}
        assert sketches.roots(own) == [least[g] for g in group]


def test_a_full_block_of_unlike_sketches_takes_seconds():
    rng = np.random.default_rng(14)
    own = [(i, rng.bytes(64), int(s)) for i, s in enumerate(rng.integers(180, 220, 16_384))]
    began = time.perf_counter()
    assert Sketches(0.8).roots(own) == list(range(16_384))
    assert time.perf_counter() - began < 60


def test_whole_table_like_brute_force(spark, small):
    """Every link at the similarity in the test table's documents is found and no other."""
    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")
    rows = [(r["doc_id"], shingle_set(r["text"])) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    index = {}
    for i, (_, own) in enumerate(rows):
        for x in own:
            index.setdefault(x, []).append(i)
    pairs = {p for at in index.values() for p in combinations(at, 2)}
    linked = [(i, j) for i, j in pairs if len(rows[i][1] & rows[j][1]) >= 0.8 * len(rows[i][1] | rows[j][1])]
    root = components(len(rows), linked)
    got = {r["doc_id"]: r["component_id"] for r in verified_groups(docs).collect()}
    assert len(linked) > 50 and got == {d: rows[root[i]][0] for i, (d, _) in enumerate(rows)}


def test_components_of_stars_chains_and_loops(spark):
    edges = [(1, 2), (3, 2), (3, 4), (4, 5), (5, 6), (10, 10), (20, 21), (21, 20), (None, 5)] + [(100, i) for i in range(101, 200)]
    edges += [(5000, i) for i in range(4000, 4600)] + [(4700, i) for i in range(4701, 5000)]  # hot as the larger and as the smaller end
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 7)} | {20: 20, 21: 20} | {i: 100 for i in range(100, 200)} | {i: 4000 for i in [*range(4000, 4600), 5000]} | {i: 4700 for i in range(4700, 5000)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_buckets_are_split_without_losing_a_pair(spark):
    """A third of the fingerprints in one bucket of some tables, found hot by the sample, and the same without a hot bucket."""
    rng = np.random.default_rng(8)
    few = [int(sum(1 << int(i) for i in rng.choice(64, 3, replace=False))) for _ in range(1500)]
    prints = {p - (1 << 64) if p >> 63 else p for p in [*few, *map(int, rng.integers(0, 2**63, 3000))]}
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(sorted(prints))], "node long, f0 long")
    entries = nodes.selectExpr("node", "f0", "0L as t", "f0 & 15 as k")
    hot = hot_buckets(entries.filter(in_sample()), ["t", "k"])
    assert hot.count()
    got = [
        sorted((r["node"], r["component"]) for r in connected_components(bucket_edges(Scratch(spark, "buckets"), *sized_buckets(entries, ["t", "k"], h), ["t", "k"], ["f0"], within(4), block=block)).collect())
        for h, block in ((hot, 300), (hot.limit(0), 65_536), (hot, 65_536))
    ]
    assert got[0] and got[0] == got[1] == got[2]


def test_empty_table(spark):
    assert simhash_groups(empty(spark, DOCS)).count() == 0 and verified_groups(empty(spark, DOCS)).count() == 0


def test_near_copies_come_by_the_fingerprints_tables_first(spark, monkeypatch):
    """What lies within the radius is found without the search for the rest, is compared exactly, and needs no test there."""
    tested = []
    monkeypatch.setattr(module, "may_reach", lambda similarity: tested.append(similarity) or (lambda a, b: np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), bool)))
    rng = random.Random(15)
    rows = []
    for _ in range(6):
        words = prose(rng, 1500).split()
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:700], "edit", *words[701:]]))]
    assert all((fingerprint(a.encode(), 5) ^ fingerprint(b.encode(), 5)).bit_count() <= 4 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    line = " ".join(f"l{i}" for i in range(15))
    rows += [(12 + i, " ".join([line] * 150) + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(100))) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in verified_groups(docs).collect()} == {i: i // 2 * 2 for i in range(12)} | {12: 12, 13: 13}
    near = module.apart(within(64))
    assert near(np.array([[1, 5], [1, 5]], np.uint64), np.array([[1, 5], [1, 6]], np.uint64)).tolist() == [False, True] and tested
