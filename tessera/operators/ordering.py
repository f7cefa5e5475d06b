"""Global orders without a task that holds all rows, and the order of the input kept across joins and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cleaning import deduplicate
from tessera.sources.tables import stored

#: Rows of a range, and ranges at most.
RANGE, RANGES = 1_000_000, 8192


def _ranged(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """``df``, stored, dealt by ranges of ``order`` and sorted there, with ``_part`` and ``_own``, the row's number in its range."""
    if ranges is None:
        ranges = max(1, min(RANGES, -(-df.count() // RANGE)))
    # A row's number in its sorted partition: the partition above 33 bits that count its rows.
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    table = stored(ranged.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    return table.withColumns({"_part": F.shiftright("_number", 33), "_own": F.col("_number").bitwiseAND((1 << 33) - 1)}).drop("_number")


def numbered(df: DataFrame, order: list[Column], name: str = "position", ranges: int | None = None) -> DataFrame:
    """``df`` with its gapless place (from 0) in ``order``.

    Rows are dealt by ranges of the order and sorted there; each range's rows are numbered on their own, and what the ranges
    before hold is added: one number a range, which the driver sums.  Rows equal in ``order`` are placed as they come.
    """
    table = _ranged(df, order, ranges)
    before, rows = 0, []
    for r in table.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    placed = table.join(F.broadcast(starts), "_part")
    return placed.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).select(*df.columns, name)


def numbered_within(df: DataFrame, group: list[str], order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with its gapless place (from 0) in ``order`` among the rows that agree on ``group``.

    As :func:`numbered`; a group that holds most rows lies in many ranges, and of those one number each is summed.
    """
    table = _ranged(df, [*(F.asc_nulls_first(g) for g in group), *order], ranges)
    parts = table.groupBy("_part", *group).agg(F.count("*").alias("n"), F.min("_own").alias("first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    shifts = parts.select(F.col("_part").alias("_p"), *named, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return table.join(shifts, same).withColumn(name, (F.col("_own") + F.col("_shift")).cast("long")).select(*df.columns, name)


def deduplicated_in_order(df: DataFrame, keys: list[str], code: str, order: str) -> tuple[DataFrame, DataFrame]:
    """:func:`deduplicate`, the kept rows with ``position``: their place in the order of the input, which ``order`` holds."""
    kept, moved = deduplicate(df, keys, code)
    return numbered(kept, [F.asc_nulls_first(order), F.asc_nulls_first(code)]), moved
