"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to cells by the nearest of some centres, and by a hash into shards of bounded size within a cell.  A
shard's graph has layers; each vector reaches layer l with probability M**-l, and a layer is one flat array of neighbour
numbers, a row per vector.  Vectors enter a layer in batches, those of the layer above first.  A batch finds its
neighbours by a search of the graph so far, links to those that are not nearer to one already chosen, and full rows are
chosen anew as links go both ways.  A search walks greedily down the upper layers and then keeps a beam of the best found
on the lowest one.  Searches run for a block of queries at once.

A query goes to the shards of its nearest cells.  How many cells that takes is measured: some of the queries are compared
with all vectors, and as many cells are searched as hold the wanted share of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partition_keys, rows_of
from tessera.llm.embed_dedup import dimension, usable

#: Vectors of a shard; links of a vector in the upper layers (twice that in the lowest); candidates that they are chosen
#: from; beam of a search.
SHARD, LINKS, CANDIDATES, BEAM = 16_384, 16, 64, 160
#: Up to so many vectors of a layer are scanned for a batch's neighbours, which is faster than to search the graph.
SCAN = 2048
#: Cells at most, and vectors that their centres are learnt from.
CELLS, SAMPLE = 1024, 16_384
#: Queries that are compared with all vectors to choose how many cells are searched, and the share of their true
#: neighbours that those cells must hold.
PROBES, HELD = 256, 0.99
_QUERIES = 256


def centres(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 4) -> np.ndarray:
    """Unit centres of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    at = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        own = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), at)
    return at


def _choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """At most m of each row's candidates (sorted, nearest first, -1 for none): first those that are nearer to the row's
    vector than to any chosen before, then the nearest of the rest."""
    rows, width = cand.shape
    own = x[cand]
    between = own @ own.transpose(0, 2, 1)
    nearest = np.full((rows, width), -np.inf, dtype=np.float32)
    count = np.zeros(rows, dtype=np.int64)
    kept = np.zeros((rows, width), dtype=bool)
    valid = cand >= 0
    for c in range(width):
        keep = valid[:, c] & (count < m) & (sims[:, c] > nearest[:, c])
        kept[:, c] = keep
        count += keep
        np.maximum(nearest, between[:, c], out=nearest, where=keep[:, None])
    spare = valid & ~kept
    kept |= spare & (np.cumsum(spare, axis=1) <= (m - count)[:, None])
    out = np.full((rows, m), -1, dtype=np.int32)
    i, c = np.nonzero(kept)
    out[i, (np.cumsum(kept, axis=1) - 1)[i, c]] = cand[i, c]
    return out


def _insert(x: np.ndarray, out: np.ndarray, at: int, upto: int, cand: np.ndarray, near: np.ndarray, m: int, cap: int) -> None:
    """Link vectors ``at`` to ``upto`` to chosen ones of their candidates (nearest first, -1 for none), and those back."""
    mine = _choose(x, cand, near, m)
    out[at:upto, :m] = mine
    source, place = np.nonzero(mine >= 0)
    _link_back(x, out, mine[source, place], source + at, cap)


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, nearest first."""
    k = min(k, sims.shape[1])
    pick = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
    near = np.take_along_axis(sims, pick, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    pick, near = np.take_along_axis(pick, order, axis=1), np.take_along_axis(near, order, axis=1)
    return np.where(near > -np.inf, np.take_along_axis(ids, pick, axis=1), -1), near


def _link_back(x: np.ndarray, out: np.ndarray, target: np.ndarray, source: np.ndarray, cap: int) -> None:
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    who, starts, counts = np.unique(target, return_index=True, return_counts=True)
    # Few targets have very many new links; those go in narrow groups so that one hub doesn't widen all rows.
    for low, high in ((0, cap), (cap, 4 * cap), (4 * cap, len(target) + 1)):
        some = np.flatnonzero((counts > low) & (counts <= high))
        for at in range(0, len(some), 512):
            pick = some[at : at + 512]
            t, width = who[pick], int(counts[pick].max())
            new = np.full((len(t), width), -1, dtype=np.int64)
            span = np.arange(width)[None, :] < counts[pick][:, None]
            new[span] = source[(starts[pick][:, None] + np.arange(width)[None, :])[span]]
            new[(new[:, :, None] == out[t][:, None, :]).any(axis=2)] = -1
            both = np.concatenate([out[t].astype(np.int64), new], axis=1)
            near = np.einsum("rd,rcd->rc", x[t], x[both])
            near[both < 0] = -np.inf
            rank = np.argsort(-near, axis=1, kind="stable")[:, : 4 * cap]
            out[t] = _choose(x, np.take_along_axis(both, rank, axis=1), np.take_along_axis(near, rank, axis=1), cap)


class Graph:
    """Layers over unit vectors (single precision) in the order of their levels: a layer is the flat neighbour array of the
    first so many vectors, lowest layer first."""

    def __init__(self, x: np.ndarray, m: int = LINKS, width: int = CANDIDATES, seed: int = 3, scan: int = SCAN):
        rng = np.random.default_rng(seed)
        n = len(x)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(m)), 12).astype(int)
        entry = rng.permutation(n)
        self.order = entry[np.argsort(-level[entry], kind="stable")]
        self.x = np.ascontiguousarray(x[self.order], dtype=np.float32)
        self.layers: list[np.ndarray] = []
        for lv in range(level.max(initial=0), -1, -1):
            self.layers.insert(0, self._layer(int((level >= lv).sum()), m, 2 * m if lv == 0 else m, width, scan))

    def _layer(self, n: int, m: int, cap: int, width: int, scan: int) -> np.ndarray:
        """Neighbours (-1 for none) of the first n vectors; the layers above are there already."""
        x, at, step = self.x[:n], 0, 64
        out = np.full((n, cap), -1, dtype=np.int32)
        while at < n:
            upto = min(n, at + step)
            low = 0 if at <= scan else at  # from here on all are compared
            sims = x[at:upto] @ x[low:upto].T
            sims[np.arange(upto - at), np.arange(at - low, upto - low)] = -np.inf
            cand, near = _top(np.broadcast_to(np.arange(low, upto), sims.shape), sims, width)
            if low:
                found, reached = self._walk(x[:at], out[:at], x[at:upto], self._descend(x[at:upto]), width)
                cand, near = _top(np.concatenate([found, cand], axis=1), np.concatenate([reached, near], axis=1), width)
            if upto > 1:
                _insert(x, out, at, upto, cand, near, m, cap)
            at, step = upto, min(512, 2 * step)
        return out

    def _descend(self, q: np.ndarray, upto: int = 0) -> np.ndarray:
        """Where a search of the layer below the finished ones, from layer ``upto`` on, starts."""
        start = np.zeros((len(q), 1), dtype=np.int64)
        for links in reversed(self.layers[upto:]):
            start = self._walk(self.x[: len(links)], links, q, start, 4)[0]
        return start

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 for none) and similarities of the best found for each query, nearest first."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        found, sims = self._walk(self.x, self.layers[0], q, self._descend(q, 1), beam)
        return np.where(found >= 0, self.order[found], -1), sims

    @staticmethod
    def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(x) + 1), dtype=bool)  # the last column stands for "none"
        seen[:, -1] = True
        ids, sims = np.full((len(q), beam), -1, dtype=np.int64), np.full((len(q), beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((len(q), beam), dtype=bool)
        new, active = start, rows
        while True:
            fresh = ~seen[active[:, None], new]
            seen[active[:, None], new] = True
            s = np.einsum("qd,qcd->qc", q[active], x[new])
            s[~fresh] = -np.inf
            all_ids = np.concatenate([ids[active], np.where(fresh, new, -1)], axis=1)
            all_sims = np.concatenate([sims[active], s], axis=1)
            all_open = np.concatenate([open_[active], fresh], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, top, axis=1), np.take_along_axis(all_sims, top, axis=1)
            open_[active] = np.take_along_axis(all_open, top, axis=1)
            active = active[open_[active].any(axis=1)]
            if not len(active):
                break
            waiting = np.where(open_[active], sims[active], -np.inf)
            k = min(at_once, beam)
            pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
            real = np.take_along_axis(waiting, pick, axis=1) > -np.inf
            open_[active[:, None], pick] = False
            at = np.where(real, ids[active[:, None], pick], -1)
            new = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(active), -1)
            new.sort(axis=1)  # a neighbour of two expanded vectors counts once
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _doubles(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision as they are, and of unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return x, y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def probed_cells(units: DataFrame, asked: DataFrame, at: np.ndarray, dim: int, k: int, held: float = HELD, probes: int = PROBES) -> int:
    """How many of the cells nearest to a query must be searched to hold a share ``held`` of the k true neighbours.

    At most ``probes`` queries, drawn by a hash, are compared with all vectors, batch by batch; a batch gives their k best.
    """
    drawn = asked.orderBy(F.xxhash64("id"), "id").limit(probes).select("id", "v").toArrow()
    if not drawn.num_rows or len(at) == 1:
        return 1
    q = _doubles(drawn.column("v").combine_chunks(), dim)[1]
    asked_ = drawn.column("id").to_numpy()
    rank = np.argsort(np.argsort(-(q @ at.T), axis=1, kind="stable"), axis=1)  # a cell's place among those nearest to a query

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4096):
            if not batch.num_rows:
                continue
            x = _doubles(batch.column(1), dim)[1]
            sims = q @ x.T
            cell = (x @ at.T).argmax(axis=1)
            lists = batch.column(0)
            alone, first = lists.value_lengths().to_numpy() == 1, lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
            sims[alone & (first == asked_[:, None])] = -np.inf  # a query's own vector, unless others equal it
            top = np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
            best = np.take_along_axis(sims, top, axis=1)
            places = np.take_along_axis(rank, cell[top], axis=1)
            row = np.repeat(np.arange(len(q)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best.ravel()), pa.array(places.ravel())], ["q", "s", "place"])

    found = units.select("ids", "v").mapInArrow(run, "q long, s double, place long").filter(F.col("s") > F.lit(float("-inf")))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "place"))).filter(F.col("n") <= k)
    counts = {r["place"]: r["n"] for r in best.groupBy("place").agg(F.count("*").alias("n")).collect()}
    want, seen = held * sum(counts.values()), 0
    for cells, n in sorted(counts.items()):
        seen += n
        if seen >= want:
            return cells + 1
    return len(at)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, beam: int = BEAM, held: float = HELD, cells: int = CELLS
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: for each row of ``queries`` the k nearest vectors found, by cosine in double
    precision on the vectors as given, ties to the smaller id; all candidates if there are fewer.

    Vectors that are null, zero, hold a null or non-finite component, or have another length than most, take no part
    on either side, nor do null ids.  Equal vectors are indexed once with the k + 1 smallest ids, which is all that a
    result can hold.  Rows with a query's id are never its results; a query id with several vectors is searched with
    one of them.  Other columns are not read.  Empty tables give no rows.

    Cells are learnt from :data:`SAMPLE` vectors at most; every vector is indexed.  A cell with more than ``shard`` vectors is
    several shards.  A task holds one shard's graph; the queries dealt to it stream past in blocks.
    """
    scratch = Scratch(vectors.sparkSession, "graph")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    dim = dimension(rows, "v")
    hashes = {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}
    good = rows.filter(usable("v", dim) & F.col("id").isNotNull()).withColumns(hashes)
    # The limit on the rank reaches the map side, so a vector with very many copies sends few of them.
    first = good.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "g").orderBy("id"))).filter(F.col("n") <= k + 1)
    units = scratch.save(first.groupBy("h", "g").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(usable("v", dim) & F.col("id").isNotNull())
    asked = scratch.save(asked.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v")))
    total = units.count()
    taken = units.orderBy(F.xxhash64("h", "g"), "h", "g").limit(SAMPLE).select("v").toArrow()
    at = centres(_doubles(taken.column(0).combine_chunks(), dim)[1], min(cells, max(1, -(-total // shard)))) if total else np.zeros((1, max(1, dim)))
    near = probed_cells(units, asked, at, dim, k, held)
    kind = dict(units.dtypes)["v"]

    def cell(batch: pa.RecordBatch) -> np.ndarray:
        return (_doubles(batch.column("v"), dim)[1] @ at.T).argmax(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4096):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(cell(batch))], ["cell"])

    sizes = {r["cell"]: r["n"] for r in units.select("v").mapInArrow(assign, "cell long").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = np.maximum(1, -(-np.array([sizes.get(c, 0) for c in range(len(at))]) // shard))
    before = np.cumsum(parts) - parts
    shards = int(parts.sum())
    tasks = min(shards, 8192)
    keys = np.array(partition_keys(tasks), dtype=np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4096):
            if batch.num_rows:
                c, h = cell(batch), batch.column("h").to_numpy()
                to = (before[c] + h.view(np.uint64) % parts[c].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys[to % tasks]), pa.array(to), *batch.columns], ["key", "shard", "at", "ids", "v"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 512):
            if not batch.num_rows:
                continue
            close = np.argsort(-(_doubles(batch.column("v"), dim)[1] @ at.T), axis=1, kind="stable")[:, :near]
            many = parts[close].sum(axis=1)
            to = np.concatenate([np.arange(before[c], before[c] + parts[c]) for row in close for c in row]).astype(np.int32)
            sent = batch.take(pa.array(np.repeat(np.arange(len(close)), many)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[to % tasks]), pa.array(to), *sent.columns], ["key", "shard", "at", "ids", "v"])

    schema = f"key int, shard int, at long, ids array<long>, v {kind}"
    dealt = units.select("h", "ids", "v").mapInArrow(deal, schema).withColumn("role", F.lit(0))
    sent = asked.select("id", F.array("id").alias("ids"), F.col("v").cast(kind)).mapInArrow(send, schema).withColumn("role", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, graph = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard_, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = np.r_[0, np.flatnonzero((shard_[1:] != shard_[:-1]) | (role[1:] != role[:-1])) + 1, len(role)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if shard_[s] != at:
                    at, parts, graph = shard_[s], [], None
                piece = (batch.column(3).slice(s, e - s), batch.column(4).slice(s, e - s))
                if role[s] == 0:
                    parts.append(piece)
                    continue
                if not parts:
                    continue  # an empty shard
                if graph is None:
                    ids = [i for p in parts for i in p[0].to_pylist()]
                    unit = np.concatenate([_doubles(p[1], dim)[1] for p in parts])
                    graph = Graph(unit)
                asked_ids = piece[0].flatten().to_pylist()
                asked_unit = _doubles(piece[1], dim)[1]
                for i in range(0, e - s, _QUERIES):
                    yield answers(graph, ids, unit, asked_ids[i : i + _QUERIES], asked_unit[i : i + _QUERIES])

    def answers(graph: Graph, ids: list, unit: np.ndarray, asked_ids: list, q: np.ndarray) -> pa.RecordBatch:
        found, _ = graph.search(q, beam)
        columns: list[list] = [[], [], []]
        for row, query in enumerate(asked_ids):
            near = found[row][found[row] >= 0]
            score = unit[near] @ q[row]
            best = sorted(((-s, i) for s, n in zip(score.tolist(), near.tolist()) for i in ids[n] if i != query))[:k]
            columns[0] += [query] * len(best)
            columns[1] += [i for _, i in best]
            columns[2] += [-s for s, _ in best]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "id", "score"])

    both = dealt.unionByName(sent).repartition(tasks, "key").sortWithinPartitions("shard", "role", "at")
    found = both.select("shard", "role", "at", "ids", "v").mapInArrow(run, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
