"""Vectors as array columns: products, norms, checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; stays in the JVM."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def vector_stats(vectors: DataFrame, column: str) -> DataFrame:
    """One row: count, smallest and largest dimension, smallest and largest norm, whether all are finite."""
    v = F.col(column)
    return vectors.agg(
        F.count("*").alias("n"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        F.min(norm(v)).alias("min_norm"),
        F.max(norm(v)).alias("max_norm"),
        F.bool_and(is_finite(v)).alias("finite"),
    )
