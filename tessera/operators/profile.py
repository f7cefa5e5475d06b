"""Profiles of tables: columns, dependencies, cross-tables, pivots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``column, n, non_null, n_distinct, missing`` (share) in long form, per group if ``by`` is given; one pass."""
    columns = list(columns or [c for c in df.columns if c not in by])
    long = df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))))
    return long.groupBy(*by, "column").agg(
        F.count("*").alias("n"), F.count("v").alias("non_null"), F.countDistinct("v").alias("n_distinct"), F.round(1 - F.count("v") / F.count("*"), 6).alias("missing")
    )


#: Bins of a range at each refinement, and rows of a bin that are counted value by value.
BINS, FEW = 4096, 100_000


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))))


def quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """``column, fraction, value``: exact quantiles of numeric columns, interpolated between the two values around each.

    A histogram finds the bin of a range that holds a wanted place, and the bin becomes the next range.  Its ends are values
    of the column, so every round splits it, and one with few rows is counted value by value.  A round reads the column
    once; what is shuffled or brought to the driver are counts, at most :data:`BINS` a place, and no task holds a column.
    Null, NaN and infinite values take no part; a column without others has no quantiles.
    """
    spark = df.sparkSession
    values = _long(df, columns).filter(F.abs("v") < F.lit(float("inf")))
    open_ = []  # (column, fraction, upper, place in the range, range)
    for r in values.groupBy("column").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        for f in fractions:
            at = f * (r["n"] - 1)
            open_ += [(r["column"], float(f), upper, int(place) + 1, r["low"], r["high"], r["n"]) for upper, place in ((False, math.floor(at)), (True, math.ceil(at)))]
    sizes = {o[0]: o[6] for o in open_}
    found: dict[tuple, float] = {}
    keys = ["column", "fraction", "upper"]
    while open_:
        found |= {o[:3]: o[4] for o in open_ if o[4] == o[5]}
        open_ = [o for o in open_ if o[4] < o[5]]
        if not open_:
            break
        wanted = spark.createDataFrame(open_, "column string, fraction double, upper boolean, place long, low double, high double, n long")
        inside = values.join(F.broadcast(wanted), "column").filter("v >= low AND v <= high")
        share = (F.col("v") / F.lit(2.0) - F.col("low") / F.lit(2.0)) / (F.col("high") / F.lit(2.0) - F.col("low") / F.lit(2.0))  # halves, so that no difference overflows
        few = F.col("n") <= FEW
        bin_ = F.when(few, F.col("v")).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double"))
        counts = inside.withColumn("bin", bin_).groupBy(*keys, "place", "bin").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("upto", upto).filter("upto >= place AND upto - c < place")
        open_ = [(r["column"], r["fraction"], r["upper"], r["place"] - r["upto"] + r["c"], r["a"], r["b"], r["c"]) for r in hit.collect()]
    rows = []
    for column in dict.fromkeys(c for c, _, _ in found):
        for f in fractions:
            low, high = found[column, float(f), False], found[column, float(f), True]
            at = f * (sizes[column] - 1)
            rows.append((column, float(f), low + (high - low) * (at - math.floor(at))))
    return spark.createDataFrame(rows, "column string, fraction double, value double")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, low, middle, high, mean`` of numeric columns, the middle an exact median."""
    whole = _long(df, columns).groupBy("column").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    middle = quantiles(df, columns, [0.5]).select("column", F.col("value").alias("middle"))
    return whole.join(middle, "column", "left").select("column", "low", "middle", "high", "mean")


def constant_columns(df: DataFrame) -> DataFrame:
    """``column, n_distinct`` of columns with at most one value."""
    return profile_columns(df).filter("n_distinct <= 1").select("column", "n_distinct")


def functional_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys, keys with several values, and whether the key determines the value."""
    per = df.groupBy(key).agg(F.countDistinct(value).alias("v"))
    return per.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("v") > 1, 1)).alias("n_broken")).withColumn("holds", F.col("n_broken") == 0)


def crosstab(df: DataFrame, rows: str, columns: str, total: str = "all") -> DataFrame:
    """Counts of each pair of values in long form, with totals of both (named ``total``)."""
    name = lambda c: F.when(F.grouping(c) == 1, F.lit(total)).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = df.cube(rows, columns).agg(F.count("*").alias("n"), name(rows).alias("row"), name(columns).alias("col"))
    return out.select("row", "col", "n")


def pivot(df: DataFrame, rows: str, columns: str, values: Sequence, agg: Column) -> DataFrame:
    """One column per value of ``columns``; the values are given, so no extra pass looks for them."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(agg)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def converted(df: DataFrame, group: str, before: Column, after: Column) -> DataFrame:
    """``group, before, after, converted`` counts with a total row (null group)."""
    count = lambda c: F.count(F.when(c, 1))
    return df.rollup(group).agg(count(before).alias("before"), count(after).alias("after"), count(before & ~after).alias("converted"))
