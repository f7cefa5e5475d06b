"""Quotas and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered_within



def sqrt_quotas(counts: DataFrame, total: int, key: str, n: str = "n") -> DataFrame:
    """``key, n, quota``: ``total`` shared by the root of the counts, largest remainders first, never above the count.

    One row per stratum comes in, so the single window runs over the strata, not over the data.
    """
    every = Window.partitionBy(F.lit(0))
    raw = F.sqrt(n) / F.sum(F.sqrt(n)).over(every) * total
    table = counts.withColumn("_raw", raw).withColumn("_floor", F.least(F.floor("_raw"), F.col(n)).cast("long"))
    table = table.withColumn("_left", F.lit(total) - F.sum("_floor").over(every))
    able = F.col("_floor") < F.col(n)
    order = Window.partitionBy(able).orderBy(F.desc(F.round(F.col("_raw") - F.floor("_raw"), 9)), key)
    more = able & (F.row_number().over(order) <= F.col("_left"))
    return table.withColumn("quota", F.col("_floor") + more.cast("long")).select(key, n, "quota")


def seeded(id_: str, seed: int = 42):
    """A fixed pseudo-random order of ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")).cast("binary"))


def stratified_take(df: DataFrame, quotas: DataFrame, stratum: str, id_: str, seed: int = 42, queue: str | None = None) -> DataFrame:
    """``quota`` rows of each stratum in a seeded order, alternating between the values of a boolean ``queue`` if given.

    No stratum gives more rows than the largest quota: ranks beyond it are cut before the shuffle, on every partition.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    order = [seeded(id_, seed), F.col(id_)]
    table = df.withColumn("_turn", F.row_number().over(Window.partitionBy(*([stratum, queue] if queue else [stratum])).orderBy(*order))).filter(F.col("_turn") <= most)
    turn = 2 * F.col("_turn") + (F.col(queue).cast("int") if queue else F.lit(0))
    table = table.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy(turn, *order))).filter(F.col("_place") <= most)
    return table.join(quotas.select(stratum, "quota"), stratum).filter("_place <= quota").drop("_turn", "_place", "quota")


def sample_units(units: DataFrame, total: int, n_first: int, cap: int, stratum: str, group: str, first: str, queue: str, id_: str = "unit_id", seed: int = 42) -> DataFrame:
    """A balanced sample with ``why``: ``n_first`` rows where ``first`` holds, then quotas by stratum, then a fill.

    No group gives more than ``cap`` rows, over all three parts.  Only a group's ``cap`` first rows in the seeded order can
    be taken, which a ranked cut finds before anything else; of the rows that come first only ``n_first`` of each queue
    are ordered with each other.
    """
    seeds = [seeded(id_, seed), F.col(id_)]
    able = units.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(first), *seeds))).filter(F.col("_n") <= cap).drop("_n")
    heads = able.filter(first).withColumn("_q", F.row_number().over(Window.partitionBy(queue).orderBy(*seeds))).filter(F.col("_q") <= n_first)
    ahead = heads.orderBy(2 * F.col("_q") + F.col(queue).cast("int"), *seeds).limit(n_first).select(id_)
    chosen = able.join(ahead, id_, "left_semi").withColumn("why", F.lit("first"))
    rest = able.join(ahead, id_, "left_anti")
    left = total - chosen.count()
    quotas = sqrt_quotas(rest.groupBy(stratum).agg(F.count("*").alias("n")), left, stratum)
    shared = stratified_take(rest, quotas, stratum, id_, seed, queue).withColumn("why", F.lit("quota"))
    lack = left - shared.count()
    fill = rest.join(shared.select(id_), id_, "left_anti").orderBy(*seeds).limit(max(0, lack)).withColumn("why", F.lit("fill"))
    return chosen.unionByName(shared).unionByName(fill)


def packed_batches(pairs: list[tuple[str, str]], size: int) -> list[list[tuple[str, str]]]:
    """First-fit batches in which no left and no right value occurs twice, for a list in memory; tables take
    :func:`conflict_free_batches`."""
    batches: list[tuple[list, set, set]] = []
    for left, right in pairs:
        fit = next((b for b in batches if len(b[0]) < size and left not in b[1] and right not in b[2]), None)
        if fit is None:
            batches.append(fit := ([], set(), set()))
        fit[0].append((left, right))
        fit[1].add(left)
        fit[2].add(right)
    return [b[0] for b in batches]




def conflict_free_batches(pairs: DataFrame, left: str, right: str, size: int, seed: int = 42, ranges: int | None = None) -> DataFrame:
    """``pairs`` with ``batch`` (struct lap_left, lap_right, block): no left and no right value occurs twice in a batch, and none has
    more than ``size`` pairs.

    The pairs of a left value are numbered, and so are those of a right value; pairs with equal two numbers never share a
    value, so these colours of the bipartite graph are cut into blocks.  A value with many pairs needs as many batches
    however they are made; beside those, all but a colour's last block are full.  Numbers come from sorted ranges, so a value
    that holds a third of the pairs is no task's burden.  Repeated pairs are pairs of their own, null is a value.
    """
    shuffled = F.xxhash64(F.lit(seed), left, right)
    out = numbered_within(pairs, [left], [shuffled], "_l", ranges)
    out = numbered_within(out, [right], [shuffled], "_r", ranges)
    out = numbered_within(out, ["_l", "_r"], [shuffled], "_n", ranges)
    batch = F.struct(F.col("_l").alias("lap_left"), F.col("_r").alias("lap_right"), F.floor(F.col("_n") / size).alias("block"))
    return out.select(*pairs.columns, batch.alias("batch"))
