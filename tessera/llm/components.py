"""Connected components over an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MOST_HOT, Scratch, hot_from, spread_join


def _pairs(df: DataFrame, a, b) -> DataFrame:
    """Edges with the larger end first, without loops."""
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, hot: list) -> DataFrame:
    """Each vertex's larger neighbours to its smallest neighbour, or to itself if it has no smaller one.

    The vertex at the centre of a star has all its rows in this join, so ``hot`` ones are dealt to many tasks.
    """
    low = _lowest(edges).select(F.col("u").alias("v"), "m")
    return spread_join(edges, low, "v", "u", hot, "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame, hot: list) -> DataFrame:
    """Each vertex's smaller neighbours, and itself, to the smallest of them."""
    low = _lowest(edges)
    moved = _pairs(spread_join(edges, low, "u", "v", hot), F.col("v"), F.col("m"))
    return moved.unionByName(_pairs(low, F.col("u"), F.col("m")))


def _state(edges: DataFrame, before: int):
    """Number and checksum of the edges, and the vertices that hold a hot share of them as their larger or smaller end, the
    largest 4,096 on either side; ``before`` is the number of edges a round ago."""
    ends = edges.select(F.xxhash64("u", "v").alias("h"), F.inline(F.array(F.struct(F.lit(True).alias("larger"), F.col("u").alias("x")), F.struct(F.lit(False).alias("larger"), F.col("v").alias("x")))))
    counts = ends.groupBy("larger", "x").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    hot = F.col("n") > hot_from(before, 256)
    largest = lambda side: F.slice(F.sort_array(F.collect_list(F.when(hot & side, F.struct("n", "x"))), False), 1, MOST_HOT)
    some = lambda side: F.transform(largest(side), lambda s: s["x"])
    return counts.agg(F.sum("n"), F.sum("h"), some(F.col("larger")), some(~F.col("larger"))).first()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges ``a, b`` with the same components: each first end keeps one edge, to its smallest second end, and its
    other second ends are tied to that one.

    For a stored table in which a first end has a bounded number of edges (one per table and block of a search) and
    second ends are few.
    """
    low = F.min("b").over(Window.partitionBy("a"))
    tied = edges.select("b", low.alias("m")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return edges.groupBy("a").agg(F.min("b").alias("b")).unionByName(tied)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Label each vertex of ``edges`` (two long columns) with the smallest vertex that it reaches.

    Alternating large-star and small-star steps until a round changes nothing; each round is written to the shared
    folder, which ends the lineage.  Their number grows with the logarithm of a component's size.  A star's centre may
    touch a third of all vertices: minima are pre-aggregated before the shuffle, hot centres are dealt to many tasks and
    no neighbour list is gathered.  Returns ``node, component``; null ends and loops are ignored; isolated vertices are
    not in the output (an empty edge table gives an empty result).
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    current = scratch.save(_pairs(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), F.col(a), F.col(b)).distinct())
    number, seen = current.count(), None
    for _ in range(max_rounds):
        if not number:
            break
        twice, checksum, hot_u, hot_v = _state(current, number)
        number, state = twice // 2, (twice, checksum)
        if state == seen:
            break
        seen = state
        following = scratch.save(_small_star(_large_star(current, hot_v).distinct(), hot_u).distinct())
        scratch.drop(current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
