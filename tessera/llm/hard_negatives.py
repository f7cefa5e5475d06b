"""Hard negatives by a two-dimensional block matrix product.

Rows and anchors are dealt into blocks and their dimensions into chunks.  A task multiplies one anchor block with one row
block over one chunk; the partial tiles of int64 scores, one per chunk, are shuffled by (anchor block, row block) and added
there, and each whole tile is reduced at once to the few rows that can still matter.

Two products are made.  The first pairs only blocks that can hold equal labels and keeps each anchor's best rows of its own
label, the positives.  Their scores give every (anchor, positive) a window of scores; the second product, over all rows,
keeps the best rows of other labels inside each window.

Anchors enter in panels of bounded size, so the tiles on disk at a time grow in proportion to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, give_back

#: Rows and anchors of a block, dimensions of a chunk, anchors of a panel.
ROWS, ANCHORS, DIMS, PANEL = 4096, 512, 32, 65_536
#: Labels with blocks of their own: those with more than this share of the rows, so at most as many labels.
OWN = 4096
#: Most tasks of one product.
TASKS = 4096
_NONE = np.iinfo(np.int64).min
_PANEL = "block string, chunk int, parts int, head binary, matrix binary"
_TILE = "ab string, rb string, chunk int, head binary, tile binary"


def squeeze(tile: np.ndarray) -> bytes:
    """An int64 tile as compressed byte planes: small scores leave the high planes empty."""
    zigzag = (tile << 1) ^ (tile >> 63)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(zigzag, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    zigzag = np.ascontiguousarray(planes.T).reshape(-1).view("<u8").reshape(shape)
    return (zigzag >> np.uint64(1)).astype(np.int64) ^ -(zigzag & np.uint64(1)).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in int64; by floating point where every partial sum is exact in it."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, able: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to k rounds of (line, column): the largest score of each line among the able columns, the first of equal ones."""
    left = np.where(able, scores, _NONE)
    able = able.copy()
    lines = np.arange(len(left))
    for _ in range(min(k, left.shape[1])):
        at = left.argmax(axis=1)
        # The lowest score is also the mark of columns that are out: prefer an able one.
        unsure = (left[lines, at] == _NONE) & able.any(axis=1)
        at[unsure] = able[unsure].argmax(axis=1)
        found = able[lines, at]
        yield lines[found], at[found]
        left[lines, at] = _NONE
        able[lines, at] = False


def _arrow(columns: dict, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.large_binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(columns[n], kinds[k] if k != "binary" else pa.binary()) for n, k in fields], names=[n for n, _ in fields])


def _panels(rows: DataFrame, dim: int, dims: int) -> DataFrame:
    """One row per block and chunk of dimensions: its matrix, and with the first chunk the block's ids, labels and windows.

    ``rows``: block, parts, row, id, label, q, seen (positives: array of struct(id, score), empty where unknown).  Lines are in
    the order of id, so of equal scores the first column is the smallest id.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        lengths = table["q"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        flat = table["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = np.zeros((table.num_rows, max(dim, 1)), np.int64)
        matrix[np.arange(matrix.shape[1])[None, :] < lengths[:, None]] = flat
        seen = table["seen"].to_pylist()
        windows = np.full((table.num_rows, max(map(len, seen)), 2), _NONE, np.int64)
        for i, found in enumerate(seen):
            for j, p in enumerate(found):
                windows[i, j] = p["id"], p["score"]
        width = windows.shape[1]
        plain = np.stack([table[c].to_numpy() for c in ("row", "id", "label")], axis=1).astype(np.int64)
        counts = np.array([[len(x)] for x in seen], np.int64)
        head = np.concatenate([plain, counts, windows.reshape(table.num_rows, 2 * width)], axis=1)
        out: dict[str, list] = {"block": [], "chunk": [], "parts": [], "head": [], "matrix": []}
        for chunk, at in enumerate(range(0, matrix.shape[1], dims)):
            shape = np.array([table.num_rows, head.shape[1]], "<i8").tobytes()
            out["block"].append(table["block"][0].as_py())
            out["chunk"].append(chunk)
            out["parts"].append(table["parts"][0].as_py())
            out["head"].append(shape + (head.astype("<i8").tobytes() if chunk == 0 else b""))
            out["matrix"].append(np.ascontiguousarray(matrix[:, at : at + dims], "<i8").tobytes())
        give_back()
        return _arrow(out, _PANEL)

    return rows.groupBy("block").applyInArrow(run, _PANEL)


def _head(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:16], "<i8")
    return np.frombuffer(data[16:], "<i8").reshape(n, width)


def _partial_tiles(anchors: DataFrame, rows: DataFrame, tasks: int) -> DataFrame:
    """Product of every anchor panel with every row panel of its group and chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _arrow({"ab": [], "rb": [], "chunk": [], "head": [], "tile": []}, _TILE)
        (a,), (b,) = left.to_pylist(), right.to_pylist()
        na, nb = (int(np.frombuffer(x["head"][:8], "<i8")[0]) for x in (a, b))
        x, y = (np.frombuffer(m["matrix"], "<i8").reshape(n, -1) for m, n in ((a, na), (b, nb)))
        head = len(a["head"]).to_bytes(8, "little") + a["head"] + b["head"]
        out = _arrow({"ab": [a["ab"]], "rb": [a["rb"]], "chunk": [a["chunk"]], "head": [head], "tile": [squeeze(product(x, y))]}, _TILE)
        give_back()
        return out

    key = ["ab", "rb", "chunk"]
    numbered = lambda group, n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.concat(group, F.lit(":"), i.cast("string")))
    group = F.substring_index("block", ":", 1)
    # Each panel carries how many blocks of the other side its group has, and goes to each of them.
    left = anchors.select(F.col("block").alias("ab"), F.explode(numbered(group, "parts")).alias("rb"), "chunk", "head", "matrix")
    right = rows.select(F.explode(numbered(group, "parts")).alias("ab"), F.col("block").alias("rb"), "chunk", "head", "matrix")
    # A fixed number of partitions: tiles cost time, not bytes, so small partitions must not be merged.
    left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, _TILE).repartition(tasks, "ab", "rb")


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a tile, added over its chunks, and the heads of its anchors and rows."""
    parts = sorted(table.to_pylist(), key=lambda p: p["chunk"])
    data = parts[0]["head"]
    cut = 8 + int.from_bytes(data[:8], "little")
    anchors, rows = _head(data[8:cut]), _head(data[cut:])
    scores = np.zeros((len(anchors), len(rows)), np.int64)
    for p in parts:
        scores += unsqueeze(p["tile"], scores.shape)
    return scores, anchors, rows


_POSITIVE = "anchor long, id long, score long"


def _positives(tiles: DataFrame, k: int) -> DataFrame:
    """Each anchor's best k other rows of its label in every tile."""

    def run(table: pa.Table) -> pa.Table:
        scores, anchors, rows = _whole(table)
        able = (anchors[:, 2][:, None] == rows[:, 2][None, :]) & (anchors[:, 1][:, None] != rows[:, 1][None, :])
        found = list(best(scores, able, k))
        i, j = (np.concatenate([f[x] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for x in (0, 1))
        give_back()
        return pa.table({"anchor": anchors[i, 0], "id": rows[j, 1], "score": scores[i, j]})

    return tiles.groupBy("ab", "rb").applyInArrow(run, _POSITIVE)


_NEGATIVE = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def _negatives(tiles: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """The best k rows of other labels in every tile for each anchor and positive, between ``least`` and ``most`` per cent of
    the positive's score."""

    def run(table: pa.Table) -> pa.Table:
        scores, anchors, rows = _whole(table)
        other = anchors[:, 2][:, None] != rows[:, 2][None, :]
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for place in range((anchors.shape[1] - 4) // 2):
            positive_id, score = anchors[:, 4 + 2 * place], anchors[:, 5 + 2 * place]
            # least * p <= 100 * s <= most * p in whole numbers.
            low, high = -((-least * score) // 100), most * score // 100
            able = other & (scores >= low[:, None]) & (scores <= high[:, None]) & (anchors[:, 3] > place)[:, None]
            for i, j in best(scores, able, k):
                columns = anchors[i, 0], anchors[i, 1], np.full(len(i), place), positive_id[i], score[i], rows[j, 1], scores[i, j]
                for into, values in zip(out, columns):
                    into.append(values)
        names = [x.split()[0] for x in _NEGATIVE.split(", ")]
        columns = [np.concatenate(c or [np.zeros(0)]).astype(np.int32 if n == "place" else np.int64) for n, c in zip(names, out)]
        give_back()
        return pa.table(dict(zip(names, columns)))

    return tiles.groupBy("ab", "rb").applyInArrow(run, _NEGATIVE)


def _parts(n: Column | str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.col(n) if isinstance(n, str) else n) / size)).cast("int")


def _label_groups(rows: DataFrame, is_anchor: Column, block: int, width: int) -> DataFrame:
    """``rows`` with ``group`` (rows of one label share it) and the numbers of row and anchor blocks of the group.

    Labels with many rows have a group of their own; the others share groups by a hash.  What is broadcast is one row for
    each label with more than 1/4,096 of all rows, 4,096 at most.
    """
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"))
    total, anchors = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("anchors"), F.lit(0))).first()
    own = counts.filter(F.col("n") >= max(block // 2, total // OWN + 1)).collect()
    small, small_anchors = total - sum(r["n"] for r in own), anchors - sum(r["anchors"] for r in own)
    # A label without a group of its own may still fill several blocks.
    parts = max(1, math.ceil(total / OWN / block))
    groups = max(1, math.ceil(small / (parts * block)))
    known = [(r["label"], f"l{r['label']}", math.ceil(r["n"] / block), max(1, math.ceil(r["anchors"] / width))) for r in own]
    table = rows.sparkSession.createDataFrame(known, "label long, group string, row_parts int, anchor_parts int")
    return rows.join(F.broadcast(table), "label", "left").withColumns(
        {
            "group": F.coalesce("group", F.concat(F.lit("h"), F.pmod(F.xxhash64("label"), F.lit(groups)).cast("string"))),
            "row_parts": F.coalesce("row_parts", F.lit(parts)),
            "anchor_parts": F.coalesce("anchor_parts", F.lit(max(1, math.ceil(small_anchors / groups / width)))),
        }
    )


def _blocks(rows: DataFrame, own: str, other: str) -> DataFrame:
    """Deal rows to the ``own`` number of blocks of their group."""
    part = F.pmod(F.xxhash64("row"), F.col(own)).cast("string")
    return rows.select(F.concat("group", F.lit(":"), part).alias("block"), F.col(other).alias("parts"), "row", "id", "label", "q", "seen")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: int = 256,
    label: Column | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block: int = ROWS,
    width: int = ANCHORS,
    dims: int = DIMS,
    panel: int = PANEL,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchor`` names.

    Rows without id, label or vector, or with a null or non-finite component, take no part.  Components become
    floor(scale * x) as 64-bit integers (the largest, where they don't fit), and a score is the inner product of those, the
    shorter vector counted as zeros beyond its end; it wraps around beyond 64 bits.  Higher scores come first, ties by smaller
    id.  An anchor's positives are its best ``positives`` rows of its label; its negatives for each positive the best
    ``negatives`` rows of other labels with least * positive_score <= 100 * score <= most * positive_score.  Rows that repeat an
    id count each on its own, but no row of an anchor's own id is its positive.  Anchors without positives, and positives
    without negatives, give no rows; an empty table gives none.  Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    chosen = (label if label is not None else F.col(label_col)).cast("long")
    able = F.col(id_col).isNotNull() & chosen.isNotNull() & vec.isNotNull() & finite
    taking = vectors.filter(able).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        chosen.alias("label"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.array().cast("array<struct<id:long,score:long>>").alias("seen"),
    )
    rows = scratch.save(taking)
    total, dim, anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.count_if("is_anchor")).first()
    by_label = _label_groups(rows, F.col("is_anchor"), block, width)
    own_rows = scratch.save(_panels(_blocks(by_label, "row_parts", "anchor_parts"), dim, dims))
    row_parts, rounds = max(1, math.ceil(total / block)), max(1, math.ceil(anchors / panel))
    anchor_parts = max(1, math.ceil(anchors / rounds / width))
    flat = {"group": F.lit("all"), "row_parts": F.lit(row_parts), "anchor_parts": F.lit(anchor_parts)}
    all_rows = scratch.save(_panels(_blocks(rows.withColumns(flat), "row_parts", "anchor_parts"), dim, dims))

    tasks = min(TASKS, max(8, row_parts * anchor_parts))
    found = []
    for turn in range(rounds):
        mine = F.col("is_anchor") & (F.pmod(F.xxhash64("row", F.lit(7)), F.lit(rounds)) == turn)
        own = _panels(_blocks(by_label.filter(mine), "anchor_parts", "row_parts"), dim, dims)
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        first = _positives(_partial_tiles(own, own_rows, tasks), positives).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
        listed = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
        seen = F.transform("best", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))
        known = rows.filter(mine).drop("seen").join(listed, F.col("row") == F.col("anchor")).withColumn("seen", seen)
        wide = _panels(_blocks(known.withColumns(flat), "anchor_parts", "row_parts"), dim, dims)
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
        last = _negatives(_partial_tiles(wide, all_rows, tasks), negatives, least, most).withColumn("rank", F.row_number().over(order))
        found.append(scratch.save(last.filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
