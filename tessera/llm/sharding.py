"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only.

The hash ring is cut into a fixed number of arcs.  Every shard has virtual nodes on it, so each arc has a fixed order in
which its clockwise walk meets the shards.  A key goes to the first shard of its arc's walk that is not full: in turn,
all arcs offer what they still hold to the next shard of their walk, which takes rows up to its capacity in ring order.
Only counts per arc are needed to plan that, so the driver holds one number per arc and never a key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arcs of the ring (a power of two) and virtual nodes of a shard.
ARC_BITS, VIRTUAL = 12, 64


def walks(shards: int, virtual: int = VIRTUAL, arc_bits: int = ARC_BITS) -> list[list[int]]:
    """For each arc the shards in the order in which its clockwise walk meets them.

    A shard's virtual nodes depend on its number alone, so one more shard only inserts itself into the walks.
    """
    arcs = 1 << arc_bits
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8]), s) for s in range(shards) for v in range(virtual))
    out, at = [], 0
    for arc in range(arcs):
        start = arc << (64 - arc_bits)
        while at < len(points) and points[at][0] < start:
            at += 1
        seen: dict[int, None] = {}
        for k in range(len(points)):
            seen[points[(at + k) % len(points)][1]] = None
            if len(seen) == shards:
                break
        out.append(list(seen))
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows a shard may hold: an equal share, the first shards one more if it is not whole, times 1 + ``slack``."""
    return [int((rows // shards + (s < rows % shards)) * (1 + slack)) for s in range(shards)]


def plan(counts: dict[int, int], orders: list[list[int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, place of the first in the shard) for stretches of every arc's rows."""
    filled, left, given = [0] * len(room), dict(counts), dict.fromkeys(counts, 0)
    out = []
    for turn in range(len(room)):
        for arc in sorted(left):
            shard = orders[arc][turn]
            n = min(left[arc], room[shard] - filled[shard])
            if n:
                out.append((arc, given[arc] + 1, given[arc] + n, shard, filled[shard]))
                filled[shard] += n
                given[arc] += n
                left[arc] -= n
        left = {a: n for a, n in left.items() if n}
    return out


def arc_of(key: Column, arc_bits: int = ARC_BITS) -> Column:
    return F.shiftrightunsigned(key, 64 - arc_bits).cast("int")


def shard_rows(docs: DataFrame, shards: int, slack: float = 0.0, virtual: int = VIRTUAL, arc_bits: int = ARC_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``: every row's shard and its place there, gapless from 0.

    ``size`` is the text's UTF-8 bytes plus 1.  With ``slack`` 0 the shards' row counts differ by at most one.  A row's key
    is its id and text, so neither a text nor an id (or the lack of one) that a third of the rows share brings them to
    one arc; only rows equal in both lie together.  Ties go by id, size and checksum.  A null text has size 1 and the
    checksum of no bytes; texts of any length are hashed whole; repeated rows are kept; other columns are not read; an
    empty table gives no rows.

    Two passes: the first counts rows per arc (at most ``2**arc_bits`` numbers); the second ranks rows inside their arc,
    which is the only shuffle and carries no text.  The plan that is broadcast has at most
    ``2**arc_bits + shards * (shards + 1)`` rows of 36 bytes, whatever the input.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    counted = docs.groupBy(arc_of(key, arc_bits).alias("arc")).count().collect()
    counts = {r["arc"]: r["count"] for r in counted}
    stretches = plan(counts, walks(shards, virtual, arc_bits), capacities(sum(counts.values()), shards, slack))
    table = docs.sparkSession.createDataFrame(stretches, "arc int, first long, last long, shard int, place long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key")
    ).withColumn("arc", arc_of(F.col("_key"), arc_bits))
    order = Window.partitionBy("arc").orderBy("_key", id_col, "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order).cast("long"))
    placed = ranked.join(F.broadcast(table), "arc").filter("_rank between first and last")
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("place") + F.col("_rank") - F.col("first")).alias("slot"))
