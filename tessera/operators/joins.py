"""Audited joins, lookups through lists, overrides, upserts and pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str | Sequence[str], order: str | Column) -> DataFrame:
    """The row with the largest ``order`` of each key (later rows overwrite earlier ones)."""
    keys = [key] if isinstance(key, str) else list(key)
    order = F.col(order) if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def join_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of counts: rows and duplicate keys of both sides, keys joined, keys of one side only, and ``is_clean``."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias(name))

    both = side(left, "l").join(side(right, "r"), key, "full")
    some = lambda c: F.count(F.when(c, 1))
    out = both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"),
        some(F.col("l") > 1).alias("dup_left"),
        some(F.col("r") > 1).alias("dup_right"),
        some(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("joined"),
        some(F.col("r").isNull()).alias("left_only"),
        some(F.col("l").isNull()).alias("right_only"),
    )
    return out.withColumn("is_clean", (F.col("dup_left") + F.col("dup_right") + F.col("left_only") + F.col("right_only")) == 0)


def join_by_id(units: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """Units with their label; of repeated keys the last row on each side counts."""
    return last_per_key(units, key, order).drop(order).join(last_per_key(labels, key, order).drop(order), key)


def explode_lookup(df: DataFrame, id_: str, codes: Column, table: DataFrame, code: str, value: str) -> DataFrame:
    """``id_, found, missing``: values of a list of codes in the list's order, and the codes that the table lacks."""
    parts = df.select(id_, F.posexplode_outer(codes).alias("pos", code))
    hit = parts.join(table.select(code, F.col(value).alias("_v"), F.lit(True).alias("_in")), code, "left")
    item = F.struct("pos", "_v")
    gap = F.struct("pos", code)
    got = F.transform(F.array_sort(F.collect_list(F.when(F.col("_in"), item))), lambda x: x["_v"])
    lost = F.transform(F.array_sort(F.collect_list(F.when(F.col("_in").isNull() & F.col(code).isNotNull(), gap))), lambda x: x[code])
    return hit.groupBy(id_).agg(got.alias("found"), lost.alias("missing"))


def override(df: DataFrame, given: DataFrame, key: str, column: str, rule: Column, allowed: Sequence) -> DataFrame:
    """``column`` from ``given`` where its value is allowed, else from ``rule``; ``source`` says whether any row was given,
    even one whose value was not used."""
    named = given.select(key, F.col(column).alias("_given"), F.lit(True).alias("_any"))
    out = df.join(named, key, "left")
    value = F.when(F.col("_given").isin(*allowed), F.col("_given")).otherwise(rule)
    source = F.when(F.col("_any"), "given").otherwise("rule")
    return out.withColumns({column: value, "source": source}).drop("_given", "_any")


def upsert_review(sheet: DataFrame, earlier: DataFrame, key: str, values: Sequence[str], reviewed: Sequence[str], order: str, recheck: str = "recheck") -> DataFrame:
    """``sheet`` (key, status, cache_key, review, values) with the reviewer's earlier values and state.

    A review is kept if its result is the same (equal cache key of a success), and is to be rechecked if the result is
    a new success.  Earlier rows without a review state or value change nothing.
    """
    old = last_per_key(earlier, key, order)
    had = F.coalesce(F.col("review").isin(*reviewed), F.lit(False))
    for v in values:
        had = had | F.col(v).isNotNull()
    old = old.filter(had).select(key, F.col("review").alias("_review"), F.col("cache_key").alias("_cache"), *(F.col(v).alias(f"_{v}") for v in values))
    out = sheet.join(old.withColumn("_old", F.lit(True)), key, "left")
    good = F.col("_old") & (F.col("status") == "success")
    state = F.when(good & (F.col("_cache") == F.col("cache_key")), F.col("_review")).when(good, F.lit(recheck)).otherwise(F.col("review"))
    changed = {v: F.coalesce(F.col(f"_{v}"), F.col(v)) for v in values}
    return out.withColumns({"review": state, **changed}).select(sheet.columns)


def merge_pool(existing: DataFrame, pool: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """``existing`` and the pool's new rows, each key once; columns that the pool lacks get ``defaults`` or an empty text."""
    new = pool.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")
    rest = {c: F.lit(defaults.get(c, "")) for c in existing.columns if c not in new.columns}
    return existing.unionByName(new.withColumns(rest).select(existing.columns) if rest else new.select(existing.columns))


def key_integrity(source: DataFrame, kept: DataFrame, moved: DataFrame, key: str, ref: str) -> DataFrame:
    """One row of counts that are zero if kept and moved keys part the source and references point at kept rows."""
    ids = lambda df: df.select(key).distinct()
    parts = {
        "in_both": ids(kept).join(ids(moved), key, "left_semi"),
        "lost": ids(source).join(ids(kept).unionByName(ids(moved)), key, "left_anti"),
        "added": ids(kept).unionByName(ids(moved)).join(ids(source), key, "left_anti"),
        "dangling": moved.select(F.col(ref).alias(key)).distinct().join(ids(kept), key, "left_anti"),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)
    return out
