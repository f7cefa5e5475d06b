"""SimHash near-duplicates with covering bit masks, and near-duplicates by the shingle sets themselves.

Every bit position of a 64-bit fingerprint is given a random non-zero vector of r+1 bits, and each non-zero vector v of
r+1 bits makes one mask: the positions whose vector has an odd dot product with v.  The positions where two fingerprints
differ, if at most r, span at most r dimensions, so some v is orthogonal to them all: under its mask the fingerprints are
equal.  Hence every pair within radius r meets in a table.

Similarity of shingle sets has no such radius: at 0.8 about 10 of 64 bits differ, now and then 20, and no number of bits
holds every pair.  There the bits that are covered are those of the sets themselves (see :func:`verified_groups`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MOST_HOT, Scratch, hot_from, maybe_among, rows_of, utf8
from tessera.llm.components import connected_components, contracted

#: The most distinct fingerprints that one task compares in one table; larger buckets are compared block by block.
BLOCK = 65_536
_STEP = 65_536


def shingle_hashes(words: list[bytes], k: int, at: int, upto: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles that start at words ``at`` to ``upto``."""
    part = words[at : upto + k - 1]
    joined = b" ".join(part)
    lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: upto - at].tolist(), ends[k - 1 :].tolist())
    return np.array([digest(joined[s:e], 42) for s, e in spans], dtype=np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.uint32)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, k: int) -> int:
    """A signed 64-bit number; A-Z are lower-cased and words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        counts += _bit_counts(shingle_hashes(words, min(k, len(words)), at, min(n, at + _STEP)))
    return _majority(counts, n)


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, f0`` of every row; texts are read whole, shingles in steps of 65,536, and never shuffled.

    Null and empty texts have fingerprint zero; null ids and repeated rows are kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 512):
            made = [fingerprint(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], [id_col, "f0"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), utf8(text_col).alias("_text")).mapInArrow(run, f"{id_col} long, f0 long")


def covering_masks(r: int, seed: int = 7) -> list[int]:
    """Unsigned 64-bit masks of ``2**(r+1) - 1`` tables: fingerprints within ``r`` bits agree under one of them at least."""
    # Each non-zero vector is used about equally often, so the masks have about equally many bits.
    vectors = np.random.default_rng(seed).permutation(np.arange(64) % (2 ** (r + 1) - 1) + 1).tolist()
    return [sum(1 << place for place, x in enumerate(vectors) if (v & x).bit_count() % 2) for v in range(1, 2 ** (r + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within(radius: int):
    """Which rows of a lie within ``radius`` bits of rows of b; leading axes are broadcast."""
    return lambda a, b: np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= radius


def may_reach(similarity: float):
    """Which rows of a may reach the Jaccard similarity with rows of b, by parities and sizes of the sets; none that does is lost.

    A row holds the set's size after the lanes of parities.  The parities differ in at most as many bits as the sets
    do in members, and sets of sizes m and n at the similarity differ in at most (m + n) (1 - s) / (1 + s).
    """

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, n = a[..., -1].astype(np.int64), b[..., -1].astype(np.int64)
        bits = sum(np.bitwise_count(a[..., i] ^ b[..., i]).astype(np.int32) for i in range(a.shape[-1] - 1))
        return (bits <= (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-6) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6)

    return near


def apart(near):
    """``near`` for rows that hold their class after what it tests: rows of one class need no test."""
    return lambda a, b: near(a[..., :-1], b[..., :-1]) & (a[..., -1] != b[..., -1])


def local_roots(prints: np.ndarray, nodes: np.ndarray, near) -> np.ndarray:
    """For each row the smallest node that it reaches inside this bucket; ``near`` is a test of rows or a radius.

    A breadth-first search in blocks: found rows leave the pool, so a dense bucket costs about its own size.
    """
    near = near if callable(near) else within(near)
    m = len(nodes)
    roots = np.empty(m, dtype=np.int64)
    left = np.argsort(nodes, kind="stable")
    while len(left):
        root, front, left = nodes[left[0]], left[:1], left[1:]
        roots[front] = root
        while len(front) and len(left):
            now, front = front[:256], front[256:]
            hit = np.zeros(len(left), dtype=bool)
            for at in range(0, len(left), 16_384):
                hit[at : at + 16_384] = near(prints[now][:, None, :], prints[left[at : at + 16_384]][None, :, :]).any(axis=0)
            found, left = left[hit], left[~hit]
            roots[found] = root
            front = np.concatenate([front, found])
    return roots


def _cluster(lanes: int, near, whole: int = 6):
    """Rows sorted by bucket in, edges (row's node, smallest node that it reaches in the bucket) out; of buckets of up to
    ``whole`` rows, six at least, every near pair."""

    def edges(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, sizes = np.r_[0, cuts], np.diff(np.r_[0, cuts, len(nodes)])
        a, b = [], []
        for n in range(2, 7):
            at = starts[sizes == n]
            for i in range(n - 1):
                for j in range(i + 1, n):
                    hit = at[near(prints[at + i], prints[at + j])]
                    a.append(np.maximum(nodes[hit + i], nodes[hit + j]))
                    b.append(np.minimum(nodes[hit + i], nodes[hit + j]))
        for s, n in zip(starts[sizes > 6].tolist(), sizes[sizes > 6].tolist()):
            own = nodes[s : s + n]
            if n <= whole:
                i, j = np.nonzero(np.triu(near(prints[s : s + n][:, None, :], prints[s : s + n][None, :, :]), 1))
                a.append(np.maximum(own[i], own[j]))
                b.append(np.minimum(own[i], own[j]))
                continue
            roots = local_roots(prints[s : s + n], own, near)
            a.append(own[roots != own])
            b.append(roots[roots != own])
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            keys = np.stack(c[: -1 - lanes], axis=1)
            now = (keys, c[-1 - lanes], np.stack([x.view(np.uint64) for x in c[-lanes:]], axis=1))
            changed = np.flatnonzero((keys != keys[-1]).any(axis=1))
            if held and (held[-1][0][-1] == keys[0]).all() and not len(changed):
                held.append(now)
                continue
            cut = changed[-1] + 1 if len(changed) else 0
            parts = [*held, tuple(x[:cut] for x in now)]
            done = [np.concatenate([p[i] for p in parts]) for i in range(3)]
            if len(done[1]):
                yield edges(*done)
            held = [tuple(x[cut:] for x in now)]
        if held:
            yield edges(*[np.concatenate([p[i] for p in held]) for i in range(3)])

    return run


#: One row in so many is looked at to find hot buckets.
SAMPLED = 64


def hot_buckets(sample: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, hot``: buckets with more than a 1/256 share of the rows or more than a million rows, the largest 4,096 of them, and
    about how many rows they have.

    ``sample`` holds the bucket keys of the entries of one node in :data:`SAMPLED`.  What is found here only decides how
    rows are dealt to tasks: a bucket that the sample misses is counted and split all the same.
    """
    counts = sample.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") > hot_from(total, 4, SAMPLED)).orderBy(F.desc("n"), *keys).limit(MOST_HOT).collect()
    return sample.sparkSession.createDataFrame([(*(r[k] for k in keys), r["n"] * SAMPLED) for r in found], ", ".join(f"{k} long" for k in (*keys, "hot")))


def in_sample(node: str = "node") -> Column:
    return F.pmod(F.xxhash64(F.lit(5), node), F.lit(SAMPLED)) == 0


def sized_buckets(entries: DataFrame, keys: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entries`` with the number of rows of their bucket as ``n``: those of other buckets, counted exactly and left in
    bucket order within their partitions, and those of the ``hot`` buckets (at most 4,096 rows) with the estimated number."""
    marked = entries.join(F.broadcast(hot), keys, "left").select(*entries.columns, "hot")
    rest = marked.filter(F.col("hot").isNull()).drop("hot")
    return rest.withColumn("n", F.count("*").over(Window.partitionBy(*keys))), marked.filter(F.col("hot").isNotNull()).withColumnRenamed("hot", "n")


def near_edges(scratch: Scratch, nodes: DataFrame, radius: int, masks: list[int], block: int = BLOCK) -> DataFrame:
    """Star edges ``a, b`` that connect what lies within ``radius`` bits, over distinct fingerprints ``node, f0``."""
    tables = [F.struct(F.lit(i).cast("long").alias("t"), F.col("f0").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]
    entries = nodes.select("node", "f0", F.inline(F.array(*tables)))
    hot = hot_buckets(entries.filter(in_sample()), ["t", "k"])
    return bucket_edges(scratch, *sized_buckets(entries, ["t", "k"], hot), ["t", "k"], ["f0"], within(radius), block)


def _small_or_passed(cluster, block: int, names: list[str]):
    """Rows of :func:`sized_buckets` in bucket order in; edges of the buckets of at most ``block`` rows out, with nulls for
    all else, and the rows of larger buckets as they are, with nulls for the edge."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((n, pa.int64()) for n in names)])

    def full(columns: dict) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, pa.int64())) for n in schema.names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def small() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fits = pa.compute.less_equal(batch.column("n"), block)
                large = batch.filter(pa.compute.invert(fits))
                if large.num_rows:
                    passed.append(full(dict(zip(names, large.columns))))
                yield batch.filter(fits).select(names[:-1])

        for edges in cluster(small()):
            yield from passed
            passed.clear()
            yield full({"a": edges.column(0), "b": edges.column(1)})
        yield from passed

    return run, ", ".join(f"{n} long" for n in schema.names)


def small_buckets(scratch: Scratch, sized: DataFrame, hot: DataFrame, keys: list[str], prints: list[str], near, most: int, whole: int = 6) -> tuple[DataFrame, DataFrame]:
    """Edges ``a, b`` of what is ``near`` by its ``prints`` in buckets of equal ``keys`` of at most ``most`` rows, and the rows of
    all larger buckets.  The rows of a bucket in ``sized`` lie in one partition, those of ``hot`` ones anywhere."""
    columns = [*keys, "node", *prints, "n"]
    run, schema = _small_or_passed(_cluster(len(prints), near, whole), most, columns)
    first = scratch.save(sized.filter("n > 1").select(columns).sortWithinPartitions(*keys).mapInArrow(run, schema))
    return first.filter("a is not null").select("a", "b"), first.filter("a is null").select(columns).unionByName(hot.select(columns))


def dealt_blocks(rows: DataFrame, keys: list[str], carried: list[str], block: int) -> DataFrame:
    """``rows`` (keys, node, carried columns, bucket size n) copied to every pair of blocks of their bucket, ``i`` and ``j``, and
    sorted by these, so that no task holds more than about two blocks of a bucket and no pair of rows is lost."""
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("node"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return rows.select(*keys, F.inline(pairs), "node", *carried).repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def bucket_edges(scratch: Scratch, sized: DataFrame, hot: DataFrame, keys: list[str], prints: list[str], near, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` that connect what is ``near`` by its ``prints`` within buckets of equal ``keys`` and size ``n``.

    Buckets of at most ``block`` rows are searched where they lie, larger and hot ones in pairs of blocks.
    """
    edges, large = small_buckets(scratch, sized, hot, keys, prints, near, block)
    return edges.unionByName(dealt_blocks(large, keys, prints, block).mapInArrow(_cluster(len(prints), near), "a long, b long"))


def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``id_col, f0, component_id``: documents linked, directly or through others, by fingerprints within ``radius`` bits.

    Every such pair meets in one of ``2**(radius + 1) - 1`` tables.  Fingerprints are collapsed before any comparison, so
    equal texts cost one row however many they are; texts are read whole, however long, and never shuffled.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows with one id are one vertex; a
    null id takes the component of its fingerprint (null if that has no other id).  Other columns of ``docs`` are not
    read.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, k, id_col, text_col))
    nodes = scratch.save(prints.groupBy("f0").agg(F.min(id_col).alias("node")).filter("node is not null"))
    edges = contracted(scratch.save(near_edges(scratch, nodes, radius, covering_masks(radius), block)))
    # A repeated id with several texts ties its fingerprints together.
    tied = prints.join(nodes, "f0").filter(F.col(id_col) != F.col("node")).select(F.col(id_col).alias("a"), F.col("node").alias("b"))
    tied = tied.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    labels = connected_components(edges.unionByName(tied).distinct())
    named = nodes.join(labels, "node", "left").select("f0", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "f0", "left").select(id_col, "f0", "component_id")


class _Postings:
    """Which rows have a shingle among their first ones, shingles ordered from the rarest.

    Sets of n shingles that reach the similarity share one of the first n - ceil(similarity * n) + 1 of each, so a
    passage that many texts share, being common, is seldom looked up.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, firsts: np.ndarray):
        self.rows = rows
        cuts = np.r_[0, np.cumsum(firsts[rows])]
        words = flat[np.arange(cuts[-1]) + np.repeat(starts[rows] - cuts[:-1], firsts[rows])]
        order = np.argsort(words, kind="stable")
        self.words, self.docs = words[order], np.repeat(rows, firsts[rows])[order]

    def candidates(self, own: np.ndarray) -> list[np.ndarray]:
        low, high = np.searchsorted(self.words, own, "left"), np.searchsorted(self.words, own, "right")
        return [self.docs[s:e] for s, e in zip(low.tolist(), high.tolist()) if e > s]


def similar_roots(sets: list[np.ndarray], nodes: np.ndarray, similarity: float) -> np.ndarray:
    """For each row the smallest node that it reaches by sets of at least that Jaccard similarity.

    A search from row to row; found rows leave the pool, so a dense group costs about its own size.
    """
    sizes = np.array([len(x) for x in sets])
    _, flat, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.r_[0, np.cumsum(sizes)]
    rare = np.argsort(np.argsort(seen, kind="stable"))[flat]  # a shingle's place from the rarest on
    flat = np.concatenate([np.sort(rare[s:e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())])
    firsts = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    roots, pool = np.empty(len(nodes), dtype=np.int64), np.ones(len(nodes), dtype=bool)
    mark = np.zeros(len(seen), dtype=np.int32)
    index, held = None, len(nodes)
    for first in np.argsort(nodes, kind="stable").tolist():
        if not pool[first]:
            continue
        front, pool[first] = [first], False
        held -= 1
        while front:
            i = front.pop()
            roots[i] = nodes[first]
            if not held:
                continue
            if index is None or 2 * held < len(index.rows):
                index = _Postings(flat, starts, np.flatnonzero(pool), firsts)
            own = flat[starts[i] : starts[i + 1]]
            near = index.candidates(own[: firsts[i]])
            if not near:
                continue
            near = np.unique(np.concatenate(near))
            near = near[pool[near]]
            near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i])]
            if not len(near):
                continue
            mark[own] = 1
            cuts = np.r_[0, np.cumsum(sizes[near])]
            at = np.arange(cuts[-1]) + np.repeat(starts[near] - cuts[:-1], sizes[near])
            shared = np.add.reduceat(mark[flat[at]], cuts[:-1])
            mark[own] = 0
            found = near[shared >= similarity * (sizes[near] + sizes[i] - shared)]
            pool[found] = False
            held -= len(found)
            front += found.tolist()
    return roots


#: Shingles that one task compares exactly; the sets of larger groups are dealt into blocks and all pairs of blocks compared.
SHINGLES = 500_000


def _verify(similarity: float):
    """Rows (group, i, j, node, set) sorted by the first three in; edges (node, smallest node that it reaches) out."""

    def edges(sets: list[bytes], nodes: list[int]) -> pa.RecordBatch:
        own = np.array(nodes, dtype=np.int64)
        roots = similar_roots([np.frombuffer(x, dtype=np.uint64) for x in sets], own, similarity)
        return pa.RecordBatch.from_arrays([pa.array(own[roots != own]), pa.array(roots[roots != own])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, nodes = None, [], []
        for batch in rows_of(batches, 1024):
            for group, i, j, node, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, i, j) != at:
                    if len(nodes) > 1:
                        yield edges(sets, nodes)
                    at, sets, nodes = (group, i, j), [], []
                sets.append(own)
                nodes.append(node)
        if len(nodes) > 1:
            yield edges(sets, nodes)

    return run


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a text without words has one, zero."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, dtype=np.uint64)
    n = max(1, len(words) - k + 1)
    parts = [shingle_hashes(words, min(k, len(words)), at, min(n, at + _STEP)) for at in range(0, n, _STEP)]
    return np.unique(np.concatenate(parts))


def fingerprint_and_set(text: bytes, k: int) -> tuple[int, np.ndarray]:
    """:func:`fingerprint` and :func:`shingle_set` of a text, whose shingles are hashed once."""
    words = text.lower().split()
    if not words:
        return 0, np.zeros(1, dtype=np.uint64)
    n = max(1, len(words) - k + 1)
    counts, parts = np.zeros(64, dtype=np.int64), []
    for at in range(0, n, _STEP):
        parts.append(shingle_hashes(words, min(k, len(words)), at, min(n, at + _STEP)))
        counts += _bit_counts(parts[-1])
    return _majority(counts, n), np.unique(np.concatenate(parts))


def _shingle_sets(k: int):
    """Rows (group, node, text) in; the text's shingle set in place of the text out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            sets = pa.array([shingle_set(t, k).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], ["grp", "node", "shingles"])

    return run


#: Buckets of up to so many texts give all their pairs that may be similar; larger ones are searched with sketches, so many
#: texts at once.
PAIRS, CROWD = 64, 8192


def sketch(x: np.ndarray) -> bytes:
    """Parities of a shingle set in at least one bit for two members, a power of two of them: two sets differ in as many members
    as their sketches in bits, at least, and a longer sketch folds to a shorter one."""
    bits = 64
    while 2 * bits < len(x):
        bits *= 2
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(bits: np.ndarray, length: int) -> np.ndarray:
    """Sketches (the last axis are their bytes) brought to a shorter length, as :meth:`Sketches.may_reach` does."""
    while bits.shape[-1] > length:
        half = bits.shape[-1] // 2
        bits = bits[..., half:] ^ bits[..., :half]
    return bits


class _Pool:
    """Sketches of one length, in the order of their sets' sizes, that no group has taken."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        self.nodes, self.sizes, self.bits = nodes, sizes, bits
        self.alive = np.ones(len(nodes), bool)
        self.short: dict[int, np.ndarray] = {bits.shape[1]: bits}

    def take(self, x: np.ndarray, m: int, share: float, least: float) -> list[tuple[int, np.ndarray, int]]:
        """Node, sketch and size of what a text of sketch ``x`` and size ``m`` may reach; it leaves the pool."""
        length = min(len(x), self.bits.shape[1])
        if length not in self.short:
            self.short[length] = _folded(self.bits, length)
        low, high = np.searchsorted(self.sizes, [least * m - 1e-6, (m + 1e-6) / least], "left") if m else (0, np.searchsorted(self.sizes, 0, "right"))
        at = low + np.flatnonzero(self.alive[low : min(len(self.sizes), high + 1)])
        if not len(at):
            return []
        n = self.sizes[at]
        differ = np.bitwise_count(self.short[length][at] ^ _folded(x, length)).sum(axis=1, dtype=np.int64)
        fits = (np.minimum(m, n) >= least * np.maximum(m, n) - 1e-6) & (differ <= (m + n) * share + 1e-6)
        at = at[fits]
        self.alive[at] = False
        return [(int(self.nodes[i]), self.bits[i], int(self.sizes[i])) for i in at]


class Sketches:
    """Which texts may reach a similarity by their sketches and sizes; none that does is lost."""

    def __init__(self, similarity: float):
        self.share, self.least = (1 - similarity) / (1 + similarity), similarity

    def may_reach(self, a: int, bits_a: int, m: int, b: int, bits_b: int, n: int) -> bool:
        if min(m, n) < self.least * max(m, n) - 1e-6:
            return False
        while bits_a > bits_b:
            bits_a //= 2
            a = (a >> bits_a) ^ (a & ((1 << bits_a) - 1))
        while bits_b > bits_a:
            bits_b //= 2
            b = (b >> bits_b) ^ (b & ((1 << bits_b) - 1))
        return (a ^ b).bit_count() <= (m + n) * self.share + 1e-6

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, size and sketch of both) in, the pairs that may reach the similarity out."""
        for batch in rows_of(batches, 4096):
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]))
            kept = [self.may_reach(int.from_bytes(x, "little"), 8 * len(x), m, int.from_bytes(y, "little"), 8 * len(y), n) for m, x, n, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def roots(self, own: list[tuple[int, bytes, int]]) -> list[int]:
        """For each (node, sketch, size) the smallest node that it reaches; found ones leave the pool.

        Sketches of one length are a matrix in the order of their sizes, so a text is compared with those alone whose size can
        match, at once.
        """
        out: dict[int, int] = {}
        pools = []
        for length in sorted({len(o[1]) for o in own}):
            rows = sorted((o for o in own if len(o[1]) == length), key=lambda o: o[2])
            bits = np.frombuffer(b"".join(o[1] for o in rows), np.uint8).reshape(-1, length)
            pools.append(_Pool(np.array([o[0] for o in rows]), np.array([o[2] for o in rows]), bits))
        for node, sketch_, size in sorted(own):
            if node in out:
                continue
            out[node] = node
            for pool in pools:
                pool.alive[pool.nodes == node] = False
            front = [(np.frombuffer(sketch_, np.uint8), size)]
            while front:
                x, m = front.pop()
                for pool in pools:
                    for n, y, other in pool.take(x, m, self.share, self.least):
                        out[n] = node
                        front.append((y, other))
        return [out[o[0]] for o in own]

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k, i, j, node, size, sketch) sorted by the first three in, star edges out."""
        at, held = None, []

        def edges() -> pa.RecordBatch:
            pairs = [(o[0], r) for o, r in zip(held, self.roots(held)) if o[0] != r]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in rows_of(batches, 4096):
            for k, i, j, node, size, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, i, j) != at:
                    if len(held) > 1:
                        yield edges()
                    at, held = (k, i, j), []
                held.append((node, own, size))
        if len(held) > 1:
            yield edges()


#: Texts from which common shingles are learnt, and the most such shingles: they only order the search.
SAMPLE, COMMON = 20_000, 500_000
#: 64-bit lanes of a set's parities.
PARITIES = 6


def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            own = np.concatenate([shingle_set(t, k) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["k"])

    return run


def common_shingles(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of ``id, _text``, sorted, and in how many texts each is there."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("_text").mapInArrow(_members(k), "k long")
    found = some.groupBy("k").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "k").limit(COMMON).toArrow()
    words, counts = found["k"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(words)
    return words[order], counts[order]


def _prefixes(k: int, similarity: float, words: np.ndarray, counts: np.ndarray):
    """Rows (id, text) in; the id, a 128-bit digest of the text's shingle set, the text's fingerprint, the set's parities, size, first
    shingles and sketch out.

    Shingles are ordered from the rarest on, those not known as common by their hash.  Two sets of n and m shingles that
    reach the similarity share one of the first n - ceil(similarity * n) + 1 and m - ceil(similarity * m) + 1, in
    whatever order, if it is one for all sets.
    """

    def first(x: np.ndarray) -> np.ndarray:
        n = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
        if not len(words):
            return x[:n]
        at = np.minimum(np.searchsorted(words, x), len(words) - 1)
        return x[np.argsort(np.where(words[at] == x, counts[at], 0), kind="stable")[:n]]

    def parities(x: np.ndarray) -> np.ndarray:
        odd = np.bincount((x % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
        return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            prints, sets = zip(*(fingerprint_and_set(t, k) for t in batch.column(1).to_pylist()))
            digests = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), dtype=np.int64).reshape(-1, 2)
            numbers = [*digests.T, np.array(prints, dtype=np.int64), *np.array([parities(x) for x in sets]).T, np.array([len(x) for x in sets], dtype=np.int64)]
            columns = [batch.column(0), *map(pa.array, numbers), pa.array([first(x).tobytes() for x in sets], pa.binary()), pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "d0", "d1", "f0", *(f"p{i}" for i in range(PARITIES)), "size", "firsts", "sketch"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, first shingles) in, one row per shingle out."""
    for batch in rows_of(batches, 1024):
        firsts = batch.column(1).to_pylist()
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) // 8 for x in firsts])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(firsts), dtype=np.int64)), pa.array(nodes)], ["k", "node"])


def verified_groups(
    docs: DataFrame,
    k: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = CROWD,
    shingles: int = SHINGLES,
    radius: int = 4,
) -> DataFrame:
    """Groups of texts linked, directly or through others, by the sets of their k-word shingles: ``id_col, component_id``.

    Texts are linked if their sets have at least that Jaccard similarity; no pair is left out.  The covering masks of
    :func:`simhash_groups` propose first: texts whose fingerprints lie within ``radius`` bits, and whose sketches do not keep
    them apart, are one class.  A fingerprint's radius can't hold all pairs at the similarity; the rest has an exact way.
    Similar sets share a shingle among the first of each (see :func:`_prefixes`).  Pairs of different classes that do, and
    that sizes, parities and then sketches do not keep apart, are proposed too; the sets of what the proposals connect are
    compared.  Of shingles that more than :data:`PAIRS`
    texts have among their first, as a large group of near copies does, no pairs are made: there a search by sketches
    takes each text out of the pool once it is reached.  Texts with one set count as one, so equal texts cost one row
    however many they are.

    Null and empty texts are one set and are linked like any other.  Rows of one id with several texts each take the
    component of their text; a null id takes that of its set (null if that has no other id).  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "verified")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("_text"))
    prints = [*(f"p{i}" for i in range(PARITIES)), "size"]
    schema = "id long, d0 long, d1 long, f0 long, " + ", ".join(f"{x} long" for x in prints) + ", firsts binary, sketch binary"
    made = scratch.save(texts.mapInArrow(_prefixes(k, similarity, *common_shingles(texts, k)), schema).withColumn("row", F.monotonically_increasing_id()))
    # First shingles are long and stay where they were made; the row that stands for a set says whose are used.
    carried = [F.any_value(x).alias(x) for x in (*prints, "sketch")]
    own = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row", "f0")))
    sets = made.groupBy("d0", "d1").agg(own.alias("own"), *carried).filter("own is not null")
    nodes = scratch.save(sets.select("d0", "d1", F.col("own.id").alias("node"), "own.row", "own.f0", *prints, "sketch"))
    sketches, sketched = Sketches(similarity), nodes.select("node", "size", "sketch")

    def may_be_copies(pairs: DataFrame) -> DataFrame:
        side = lambda name: sketched.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(sketches.pairs, "a long, b long")

    # First the operator's tables of fingerprints; what they link needs no test in the search for the rest.
    heads = scratch.save(nodes.groupBy("f0").agg(F.min("node").alias("node")))
    equal = nodes.select("f0", F.col("node").alias("a")).join(heads.withColumnRenamed("node", "b"), "f0").filter("a <> b").select("a", "b")
    linked = scratch.save(may_be_copies(near_edges(scratch, heads, radius, covering_masks(radius)).unionByName(equal).distinct()))
    classes = connected_components(linked).withColumnRenamed("component", "class")
    other = scratch.save(made.select("row", F.col("id").isNotNull().alias("named")).join(nodes.select("row"), "row", "left_anti").filter("named").select("row"))
    maybe = maybe_among(made.filter("id is not null").select("row", F.col("id").alias("node"), "firsts"), other, "row", "_maybe")
    chosen = maybe.filter("not _maybe").unionByName(maybe.filter("_maybe").join(other, "row", "left_anti").select(maybe.columns))
    postings = lambda df: df.select("node", "firsts").mapInArrow(_postings, "k long, node long")
    hot = hot_buckets(postings(chosen.filter(in_sample())), ["k"])
    # Most first shingles are in one set only; the others alone take parities along.
    lanes = [*prints, "class"]
    known = scratch.save(nodes.select("node", *prints).join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
    shared, common = (x.filter("n > 1").join(known, "node").select("k", "node", *lanes, "n") for x in sized_buckets(postings(chosen), ["k"], hot))
    near, large = small_buckets(scratch, shared.repartition("k"), common, ["k"], lanes, apart(may_reach(similarity)), PAIRS, PAIRS)
    crowds = dealt_blocks(large.select("k", "node", "n").join(sketched, "node"), ["k"], ["size", "sketch"], block).mapInArrow(sketches.blocks, "a long, b long")
    proposed = scratch.save(linked.unionByName(may_be_copies(near.distinct())).unionByName(crowds).distinct())
    keyed = made
    made = scratch.save(keyed.select("id", "d0", "d1"))
    scratch.drop(keyed)
    members = scratch.save(connected_components(proposed).select(F.col("node").alias("id"), F.col("component").alias("_grp")))
    # Only the texts of proposed documents travel, and few others.
    near = maybe_among(texts, members.select("id"), "id", "_maybe").filter("_maybe").drop("_maybe")
    read = near.join(members.hint("shuffle_hash"), "id").select("_grp", F.col("id").alias("_node"), "_text")
    sets = scratch.save(read.mapInArrow(_shingle_sets(k), "grp long, node long, shingles binary"))
    totals = sets.groupBy("grp").agg(F.ceil(F.sum(F.octet_length("shingles")) / F.lit(8 * shingles)).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = sets.join(totals, "grp").select("grp", F.inline(pairs), "node", "shingles")
    edges = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_verify(similarity), "a long, b long")
    labels = connected_components(edges.distinct())
    ids = nodes.select("d0", "d1", "node")
    named = ids.join(labels, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component_id"))
    return made.select(F.col("id").alias(id_col), "d0", "d1").join(named, ["d0", "d1"], "left").select(id_col, "component_id")


def one_per_group(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its group's (``groups`` of :func:`verified_groups`); equal rows count as one.

    Rows of ids that are surely neither dropped nor repeated stay where they are; the others are joined by id.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    own = F.col(id_col) == F.col("component_id")
    special = scratch.save(groups.groupBy(id_col).agg(F.max(own).alias("_kept"), F.count("*").alias("_n")).filter("not _kept or _n > 1").select(id_col, "_kept"))
    marked = maybe_among(docs, special.select(id_col), id_col, "_maybe")
    free = marked.filter("not _maybe").drop("_maybe")
    checked = marked.filter("_maybe").drop("_maybe").join(special.hint("shuffle_hash"), id_col, "left").filter("_kept is null or _kept").drop("_kept")
    single = checked.withColumn("_text", F.xxhash64(text_col)).dropDuplicates([id_col, "_text"]).drop("_text")
    return free.unionByName(single)
