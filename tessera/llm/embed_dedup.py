"""Near-duplicate vectors by an exact metric range join.

On unit vectors, cosine >= c is Euclidean distance <= r with r = sqrt(2 - 2c).  Two kinds of cells split the space:

* balls of radius r/2 around the centres of dense groups (found on a bounded sample): any two vectors inside are
  linked by the triangle inequality, so a ball's own pairs are counted and never compared.  A vector outside can only
  link with one inside if it lies within 1.5 r of the centre; those visit the ball;
* for all other vectors, the cells of the nearest pivot.  A vector visits another cell if its distance to the plane
  between the two pivots, a lower bound of its distance to every point there, is at most r.

Each pair is compared in exactly one cell, and cells are joined independently: a cell's own vectors are held in blocks
of bounded size, visitors stream past them.  Of two cells, as of two blocks of one, the one whose turn it is by the parity
of their numbers receives the other's vectors, so that all receive about equally many.  Blocks grow with the root of the
number of vectors, and so do the copies of a vector where the bound excludes no cell, up to the largest block that a task
should hold.  A block returns link counts and the edges of a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partition_keys
from tessera.llm.components import connected_components

#: Vectors that pivots and balls are chosen from; the least and the most of a block's own vectors; members in the sample
#: that make a group dense.
SAMPLE, BLOCK, DENSE = 4096, (2048, 65_536), 8
#: Similarities that a block computes at once.
_AT_ONCE = 1 << 24


def block_size(total: int) -> int:
    """Own vectors of a block for a join of ``total`` vectors."""
    return min(BLOCK[1], max(BLOCK[0], int(20 * math.sqrt(total))))


def receives(own, other) -> np.ndarray:
    """Whether, of each two cells or blocks, ``own`` receives the vectors of ``other``; of a pair exactly one does."""
    own, other = np.broadcast_arrays(own, other)
    return (own != other) & np.where((own + other) % 2 == 0, own < other, own > other)


def usable(column: str, dim: int) -> F.Column:
    """Whether a vector takes part: right length, no null or non-finite component, not all zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(c.isNotNull() & (F.size(c) == dim) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """The most common length of the vectors (0 if there is none); others take no part."""
    top = vectors.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors (double) of an array column without nulls."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_cells(sample: np.ndarray, r: float, pivots: int, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Centres of dense groups and pivots for the rest, from a sample of unit vectors."""
    near = np.zeros(len(sample), dtype=np.int64)
    least = 1 - r * r / 2
    for at in range(0, len(sample), 1024):
        near[at : at + 1024] = (sample[at : at + 1024] @ sample.T >= least).sum(axis=1)
    centres, left = [], near >= dense
    while left.any():
        top = np.flatnonzero(left)[np.argmax(near[left])]
        members = sample @ sample[top] >= least
        centre = sample[members].sum(axis=0)
        centres.append(centre / np.linalg.norm(centre))
        left &= ~(members | (sample @ centres[-1] >= least))
    rest = sample[near < dense]
    rest = rest if len(rest) else sample[:1]
    dim = sample.shape[1]
    return np.array(centres).reshape(-1, dim), rest[: max(1, pivots)]


class Cells:
    """Where vectors belong and which cells they visit.  Ball b is cell b, pivot p is cell len(balls) + p."""

    def __init__(self, balls: np.ndarray, pivots: np.ndarray, r: float):
        self.balls, self.pivots, self.r, self.eps = balls, pivots, r, 1e-7
        gaps = 2 - 2 * pivots @ pivots.T
        self.apart = np.sqrt(np.maximum(gaps, 1e-30))

    def core(self, x: np.ndarray) -> np.ndarray:
        """The ball that holds each vector, or -1."""
        if not len(self.balls):
            return np.full(len(x), -1)
        c = x @ self.balls.T
        best = c.argmax(axis=1)
        d = np.sqrt(np.maximum(0, 2 - 2 * c[np.arange(len(x)), best]))
        return np.where(d <= self.r / 2 - self.eps, best, -1)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of each vector, and the visits as (row, cell)."""
        core, nb = self.core(x), len(self.balls)
        rows, cells = [], []
        if nb:
            d = np.sqrt(np.maximum(0, 2 - 2 * x @ self.balls.T))
            # Of two balls the one with the lower number compares their pairs.
            visit = (d <= 1.5 * self.r + self.eps) & ((core[:, None] < 0) | (core[:, None] > np.arange(nb)))
            i, j = np.nonzero(visit)
            rows.append(i)
            cells.append(j)
        c = x @ self.pivots.T
        home = c.argmax(axis=1)
        # Half the difference of the squared distances over the pivots' distance is the distance to the plane.
        plane = (c[np.arange(len(x)), home][:, None] - c) / self.apart[home]
        visit = (plane <= self.r + self.eps) & receives(np.arange(len(self.pivots))[None, :], home[:, None]) & (core[:, None] < 0)
        i, j = np.nonzero(visit)
        rows.append(i)
        cells.append(j + nb)
        return np.where(core >= 0, core, home + nb), np.concatenate(rows), np.concatenate(cells)


def _sums(hit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the sum of ``n`` where ``hit`` holds; hits are few."""
    i, j = np.nonzero(hit)
    return np.bincount(i, n[j], len(hit)).astype(np.int64)


class Block:
    """A cell's own vectors in one task: counts of links and a forest that connects what is linked."""

    def __init__(self, least: float, ball: bool):
        self.least, self.ball, self.parts = least, ball, []
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def own(self, nodes: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((nodes, n, x))

    def ready(self) -> None:
        self.nodes, self.n, self.x = (np.concatenate(p) for p in zip(*self.parts))
        self.parts = [()]  # the arrays are free to go; a block that has vectors stays one
        self.x32, self.links, self.label = self.x.astype(np.float32), np.zeros(len(self.nodes), dtype=np.int64), np.arange(len(self.nodes))
        self.step = max(16, _AT_ONCE // len(self.nodes))
        if self.ball:  # all linked with each other; counted from the ball's total
            self.label[:] = 0
            return
        for at in range(0, len(self.nodes), self.step):
            hit = self._hits(self.x[at : at + self.step])
            hit[np.arange(at, min(at + self.step, len(hit))), np.arange(hit.shape[1])] = False
            self.links += _sums(hit, self.n[at : at + self.step])
            self._join(hit, self.nodes[at : at + self.step])

    def _hits(self, x: np.ndarray) -> np.ndarray:
        """Single precision decides far from the threshold, double near it."""
        c = self.x32 @ x.astype(np.float32).T
        margin = 2e-7 * x.shape[1] + 2e-6
        hit = c >= self.least + margin
        i, j = np.nonzero(np.abs(c - self.least) < margin)
        if len(i):
            hit[i, j] = (self.x[i] * x[j]).sum(axis=1) >= self.least
        return hit

    def _join(self, hit: np.ndarray, others: np.ndarray) -> None:
        """Edge of each linked other to one own vector; own vectors that it ties together are merged."""
        columns = np.flatnonzero(hit.any(axis=0))
        if not len(columns):
            return
        rows = np.flatnonzero(hit.any(axis=1))
        small = hit[np.ix_(rows, columns)]
        first = rows[small.argmax(axis=0)]
        self.edges.append((others[columns], self.nodes[first]))
        while len(columns):
            labels = self.label[rows][:, None]
            low = np.where(small, labels, len(self.label)).min(axis=0)
            high = np.where(small, labels, -1).max(axis=0)
            split = low != high
            if not split.any():
                return
            small, columns = small[:, split], columns[split]
            tied = np.unique(self.label[rows[small[:, 0]]])
            self.edges.append((self.nodes[tied[1:]], np.full(len(tied) - 1, self.nodes[tied[0]])))
            self.label[np.isin(self.label, tied[1:])] = tied[0]

    def visit(self, nodes: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = self._hits(x)
        self.links += _sums(hit, n)
        self._join(hit, nodes)
        return nodes, _sums(hit.T, self.n)


_OUT = "node long, links long, other long"


def _cell_join(least: float, dim: int, balls: int):
    """Rows (cell, block, role, node, n, v) sorted by the first three in; (node, links, null) and edges (node, 0, other) out."""

    def rows(nodes, links, other=None) -> pa.RecordBatch:
        other = pa.nulls(len(nodes), pa.int64()) if other is None else pa.array(other)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64)), other], ["node", "links", "other"])

    def finish(block: Block) -> Iterator[pa.RecordBatch]:
        if not hasattr(block, "nodes"):
            return
        some = block.links > 0
        if some.any():
            yield rows(block.nodes[some], block.links[some])
        yield from forest(block)

    def forest(block: Block) -> Iterator[pa.RecordBatch]:
        for a, b in block.edges:
            if len(a):
                yield rows(a, np.zeros(len(a), dtype=np.int64), b)
        block.edges = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, role, nodes, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            x = matrix(batch.column(5), dim)
            change = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])
            cuts = np.r_[0, np.flatnonzero(change) + 1, len(cell)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if (cell[s], part[s]) != at:
                    if block is not None:
                        if block.parts and not hasattr(block, "nodes"):
                            block.ready()
                        yield from finish(block)
                    at, block = (cell[s], part[s]), Block(least, cell[s] < balls)
                if role[s] == 0:
                    block.own(nodes[s:e], n[s:e], x[s:e])
                    continue
                if not block.parts:
                    continue  # an empty block has nothing to compare
                if not hasattr(block, "nodes"):
                    block.ready()
                for i in range(s, e, block.step):
                    j = min(e, i + block.step)
                    found, links = block.visit(nodes[i:j], n[i:j], x[i:j])
                    some = links > 0
                    if some.any():
                        yield rows(found[some], links[some])
                    yield from forest(block)
        if block is not None:
            if block.parts and not hasattr(block, "nodes"):
                block.ready()
            yield from finish(block)

    return run


def linked_vectors(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, block: int | None = None, dense: int = DENSE) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row: links are pairs with cosine >= ``least``, all and only those.

    Vectors that are null, zero, hold a null or non-finite component, or have another length than most, link with
    nothing (0 links, own component, kept).  Equal vectors are one unit with a count before anything is compared, and
    each copy links with the others.  Rows with one id and different vectors are one vertex whose links add up; a null
    id takes its unit's component.  Nothing depends on the order of equal similarities.  Other columns are not read.  An
    empty table gives no rows.

    The driver holds ``sample`` vectors at most; ball and pivot tables derived from them go to the tasks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    r = math.sqrt(2 - 2 * least)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    dim = dimension(rows, "v")
    good = usable("v", dim)
    # Two hashes of the vector stand for it where rows are matched again.
    signed = rows.withColumn("good", good).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    units = scratch.save(signed.filter("good").groupBy("h", "g").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")))
    taken = units.orderBy(F.xxhash64("h", "g"), "h", "g").limit(sample).select("v").toArrow()
    total = units.count()
    chosen = matrix(taken.column(0).combine_chunks(), dim) if total else np.zeros((0, max(dim, 1)))
    if not total:
        return signed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    block = block or block_size(total)
    balls, pivots = choose_cells(chosen, r, -(-total // block), dense)
    cells = Cells(balls, pivots, r)
    nb = len(balls)
    share = np.bincount(cells.of(chosen)[0], minlength=nb + len(pivots)) * (total / len(chosen))
    blocks = np.maximum(1, np.ceil(share / block)).astype(np.int64)
    # Every block is a task of its own, up to a number of tasks.
    offset = np.cumsum(blocks) - blocks
    tasks = int(min(blocks.sum(), 8192))
    keys = np.array(partition_keys(tasks), dtype=np.int32)
    kind = dict(units.dtypes)["v"]
    item = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ball = cells.core(matrix(batch.column(4), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ball)], ["h", "g", "node", "n", "ball"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                h, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                home, i, c = cells.of(matrix(batch.column(4), dim))
                own = (h.view(np.uint64) % blocks[home].astype(np.uint64)).astype(np.int64)
                # A visitor meets every block of a cell; a pivot's own vector the blocks of its cell that receive its block.
                visits = np.repeat(np.arange(len(i)), blocks[c])
                part = np.arange(len(visits)) - np.repeat(np.cumsum(blocks[c]) - blocks[c], blocks[c])
                others = np.where(home < nb, 0, blocks[home])
                again = np.repeat(np.arange(len(home)), others)
                earlier = np.arange(len(again)) - np.repeat(np.cumsum(others) - others, others)
                mine = receives(earlier, own[again])
                again, earlier = again[mine], earlier[mine]
                row = np.concatenate([np.arange(len(home)), i[visits], again])
                columns = (
                    np.concatenate([home, c[visits], home[again]]),
                    np.concatenate([own, part, earlier]),
                    np.concatenate([np.zeros(len(home), dtype=np.int64), np.ones(len(visits) + len(again), dtype=np.int64)]),
                    node[row],
                    n[row],
                )
                vectors_ = batch.column(4).take(pa.array(row)).cast(item)
                key = keys[(offset[columns[0]] + columns[1]) % tasks]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(x) for x in columns), vectors_], ["key", "cell", "part", "role", "node", "n", "v"])

    source = units.filter("node is not null").select("h", "g", "node", "n", "v")
    dealt = source.mapInArrow(deal, f"key int, cell long, part long, role long, node long, n long, v {kind}")
    joined = dealt.repartition(tasks, "key").sortWithinPartitions("cell", "part", "role").drop("key").mapInArrow(_cell_join(least, dim, nb), _OUT)
    found = scratch.save(joined)
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    inside = scratch.save(source.mapInArrow(core, "h long, g long, node long, n long, ball long").filter("ball >= 0").select("node", "n", "ball"))
    held = inside.groupBy("ball").agg(F.sum("n").alias("held"), F.min("node").alias("low"))
    # At most one row per ball, and no more balls than sampled vectors.
    inside = inside.join(F.broadcast(held), "ball")
    links = links.unionByName(inside.select("node", (F.col("held") - F.col("n")).alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    edges = edges.unionByName(inside.select(F.col("node").alias("a"), F.col("low").alias("b")))
    labels = connected_components(edges.distinct())
    named = units.select("h", "g", "node", "n").join(links, "node", "left").join(labels, "node", "left")
    named = named.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"), F.lit(True).alias("good"))
    out = signed.drop("v").join(named, ["h", "g", "good"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
