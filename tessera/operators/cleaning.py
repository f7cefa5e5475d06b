"""Cleaning of catalogue tables: category ladders, exact deduplication with a map, sentinels, record groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import any_of, unit_id


def ladder(*rungs: tuple[Column, str], default: str) -> Column:
    """The value of the last rung whose condition holds: later rungs overwrite earlier ones."""
    out = None
    for condition, value in reversed(rungs):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(default)


def first_match(text: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern found in ``text``."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns), F.lit(default))


def keyword_class(text: Column, strong: Sequence[str], weak: Sequence[str], against: Sequence[str]) -> Column:
    """Whether a strong keyword is contained, or a weak one and none that speaks against it (null text: as "None")."""
    text = F.coalesce(text.cast("string"), F.lit("None"))
    return text.rlike(any_of(strong)) | (text.rlike(any_of(weak)) & ~text.rlike(any_of(against)))


def names_company(c: Column, sentinel: str) -> Column:
    """Whether a company is given; only the sentinel says none, so a null counts as given."""
    return ~c.eqNullSafe(F.lit(sentinel))


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def deduplicate(df: DataFrame, keys: Sequence[str], code: str, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept rows, map of the others: code, kept_code, carried columns).

    Rows that agree on ``keys``, nulls being equal, keep the one with the smallest code.  The kept code is a grouped
    minimum, pre-aggregated before the shuffle; a group of any size is never gathered.
    """
    low = df.groupBy(*keys).agg(F.min(code).alias("kept_code")).select(*(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)), "kept_code")
    same = None
    for i, k in enumerate(keys):
        part = F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}"))
        same = part if same is None else same & part
    marked = df.join(low, same).drop(*(f"_key{i}" for i in range(len(keys))))
    kept = marked.filter(F.col(code).eqNullSafe(F.col("kept_code"))).drop("kept_code")
    moved = marked.filter(~F.col(code).eqNullSafe(F.col("kept_code"))).select(code, "kept_code", *carry)
    return kept, moved


def record_groups(df: DataFrame, keys: Sequence[str], code: str, carry: Sequence[str], fill: dict[str, str] | None = None) -> DataFrame:
    """Rows that agree on ``keys`` as one: unit_id, first non-null of each carried column in code order, code, codes, n.

    The id is a hash of the keys; null keys count as empty, or as ``fill`` says, and empty ones likewise.
    """
    parts = []
    for k in keys:
        value = F.coalesce(F.col(k).cast("string"), F.lit(""))
        parts.append(F.when(value == "", F.lit(fill[k])).otherwise(value) if fill and k in fill else value)
    marked = df.withColumn("unit_id", unit_id(parts))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(code))).alias(c) for c in carry]
    ordered = F.array_join(F.array_sort(F.collect_list(F.col(code).cast("string"))), ";")
    return marked.groupBy("unit_id").agg(*first, F.min(code).alias(code), ordered.alias("codes"), F.count("*").alias("n"))


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, rows beyond the first of their key, rows whose key occurs more than once."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_in_groups"),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
