"""Ranking quality: gains, precision, reciprocal rank, condensed metrics, bootstrap, agreement."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column, place: Column) -> Column:
    """Discounted gain of a grade at a place (from 1)."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + F.lit(1.0))


def judgment_grades(rows: DataFrame, approved: str | None = None) -> DataFrame:
    """``query, id, grade``: graded rows (of the approved state only, if given); of repeated keys one row counts."""
    text = F.trim(F.coalesce(F.col("grade").cast("string"), F.lit("")))
    table = rows.withColumn("grade", text).filter("grade <> ''")
    if approved is not None:
        table = table.filter(F.col("review") == approved)
    return table.select("query", "id", F.col("grade").cast("double").cast("int").alias("grade"))


def ideal_gains(grades: DataFrame, k: int) -> DataFrame:
    """``query, ideal``: the gain of the k best of all grades of a query."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))
    return grades.withColumn("_p", place).filter(F.col("_p") <= k).groupBy("query").agg(F.sum(gain(F.col("grade"), F.col("_p"))).alias("ideal"))


def per_query(results: DataFrame, grades: DataFrame, k: int, relevant: int = 2) -> DataFrame:
    """``query, returned, unjudged, precision, ndcg, rr, n_relevant, n_partial`` over results (query, id, rank).

    What was not judged counts as grade 0 and is counted.  Precision divides by k even if fewer were returned.
    """
    top = results.filter(F.col("rank") <= k).join(grades, ["query", "id"], "left")
    top = top.withColumn("g", F.coalesce("grade", F.lit(0)))
    good = F.col("g") >= relevant
    some = lambda c: F.count(F.when(c, 1))
    out = top.groupBy("query").agg(
        F.count("*").alias("returned"),
        some(F.col("grade").isNull()).alias("unjudged"),
        (some(good) / F.lit(float(k))).alias("precision"),
        F.sum(gain(F.col("g"), F.col("rank"))).alias("dcg"),
        F.coalesce(F.max(F.when(good, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        some(good).alias("n_relevant"),
        some(F.col("g") == 1).alias("n_partial"),
    )
    out = out.join(ideal_gains(grades, k), "query", "left")
    ndcg = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return out.select("query", "returned", "unjudged", "precision", ndcg.alias("ndcg"), "rr", "n_relevant", "n_partial")


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over queries; the unjudged share is a ratio of sums."""
    return metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("n_queries"),
        F.avg("precision").alias("precision"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("rr").alias("mrr"),
        (F.sum("unjudged") / F.greatest(F.sum("returned"), F.lit(1))).alias("unjudged"),
    )


def condensed(results: DataFrame, grades: DataFrame, neighbours: DataFrame, k: int = 5, pool: int = 20, recall_at: int = 10) -> DataFrame:
    """``query, ndcg, recall``: gains over judged results only, and the share of grade-2 items among the nearest.

    ``recall`` is null for a query without grade-2 items.
    """
    judged = results.filter(F.col("rank") <= pool).join(grades, ["query", "id"])
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    dcg = judged.withColumn("_p", place).filter(F.col("_p") <= k).groupBy("query").agg(F.sum(gain(F.col("grade"), F.col("_p"))).alias("dcg"))
    best = grades.filter("grade = 2")
    hits = neighbours.filter(F.col("rank") <= recall_at).join(best.select("query", "id"), ["query", "id"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    all_ = best.groupBy("query").agg(F.count("*").alias("n"))
    out = results.select("query").distinct().join(dcg, "query", "left").join(ideal_gains(grades, k), "query", "left").join(all_, "query", "left").join(hits, "query", "left")
    ndcg = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    recall = F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.least(F.lit(recall_at), F.col("n")))
    return out.select("query", ndcg.alias("ndcg"), recall.alias("recall"))


def experiment(results: DataFrame, grades: DataFrame, by: list[str], k: int = 5, pool: int = 20, recall_at: int = 10) -> DataFrame:
    """``by, query, ndcg, unjudged, condensed, recall`` of every run (a value of ``by``, such as model and seed) and query of
    ``results`` (by, query, id, rank).

    A run's queries are queries of their own to the metrics; judgments are joined to those that were asked.
    """
    key = F.struct(*by, "query")
    own = results.select(key.alias("query"), "id", "rank")
    judged = results.select(*by, "query").distinct().join(grades, "query").select(key.alias("query"), "id", "grade")
    at_k = per_query(own, judged, k).select("query", "ndcg", (F.col("unjudged") / F.greatest(F.col("returned"), F.lit(1))).alias("unjudged"))
    deep = condensed(own, judged, own, k, pool, recall_at).select("query", F.col("ndcg").alias("condensed"), "recall")
    return at_k.join(deep, "query").select("query.*", "ndcg", "unjudged", "condensed", "recall")


def bootstrap_draws(n: int, iterations: int, seed: int) -> list[list[int]]:
    """How often each of n items is drawn in each iteration; Python's generator, so that other tools can repeat it."""
    rng = random.Random(seed)
    places = range(n)
    out = []
    for _ in range(iterations):
        counts = [0] * n
        for _ in places:
            counts[rng.choice(places)] += 1
        out.append(counts)
    return out


def poisson_thresholds(bits: int = 32) -> list[int]:
    """Where a number of so many bits stands for one draw more: the sums of the Poisson distribution of mean 1."""
    out, below, term = [], 0.0, math.exp(-1)
    for n in range(1, 12):
        below += term
        term /= n
        out.append(round(below * 2**bits))
    return [t for t in out if t < 2**bits]


def resampling_weight(iteration: Column, key: Column, seed: int) -> Column:
    """How often an item is drawn in an iteration: a Poisson number of mean 1 from a hash, so that any tool can repeat it and no
    table of draws is needed."""
    text = F.concat_ws("|", F.lit(str(seed)), iteration.cast("string"), key.cast("string"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return reduce(lambda a, b: a + b, ((number >= t).cast("int") for t in poisson_thresholds()))


def paired_bootstrap(diffs: DataFrame, iterations: int = 2000, seed: int = 0, draws: list[list[int]] | None = None) -> DataFrame:
    """One row: mean difference, 95 % interval, number, whether it holds 0, over ``diffs`` (query, diff), one row a query.

    Every difference meets every iteration where it lies, weighed by :func:`resampling_weight`; what is shuffled is one sum an
    iteration and task.  Sums are made in billionths, so they don't depend on their order; an iteration that draws nothing
    has the mean of all.  ``draws`` are used in place of weights, in query order, for small fixtures (:func:`bootstrap_draws`).
    """
    spark = diffs.sparkSession
    exact = diffs.select("query", F.col("diff").cast("decimal(20,9)").alias("diff"))
    mean, n = exact.agg(F.sum("diff").cast("double") / F.count("*"), F.count("*")).first()
    if not n:
        raise ValueError("no differences to resample")
    if draws is None:
        drawn = exact.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        drawn = drawn.withColumn("c", resampling_weight(F.col("k"), F.col("query"), seed))
    else:
        place = {r["query"]: i for i, r in enumerate(exact.select("query").orderBy("query").collect())}
        table = spark.createDataFrame([(q, k, counts[i]) for q, i in place.items() for k, counts in enumerate(draws)], f"query {dict(diffs.dtypes)['query']}, k int, c int")
        drawn = exact.join(table, "query")
    sums = drawn.groupBy("k").agg(F.sum(F.col("c") * F.col("diff")).cast("double").alias("s"), F.sum("c").alias("w"))
    means = sums.select(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(mean).alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("all"))  # one number an iteration
    at = lambda place: F.element_at("all", place + 1)
    out = ordered.select(F.lit(mean).alias("mean_diff"), F.lit(n).cast("long").alias("n"), at(int(0.025 * iterations)).alias("low"), at(int(0.975 * iterations) - 1).alias("high"))
    return out.withColumn("holds_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def kappa(pairs: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """One row: n, agreed, simple and quadratically weighted kappa of two raters over ``values``."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    place = F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (v, i)))
    cells = cells.withColumns({"x": place[F.col(a)], "y": place[F.col(b)]}).filter("x is not null and y is not null")
    w = Window.partitionBy(F.lit(0))  # one row per pair of values
    cells = cells.withColumns({"total": F.sum("n").over(w), "rx": F.sum("n").over(Window.partitionBy("x")), "cy": F.sum("n").over(Window.partitionBy("y"))})
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("rx")), cells.groupBy("y").agg(F.sum("n").alias("cy"))
    chance = rows.join(cols).agg(
        F.sum(F.when(F.col("x") == F.col("y"), F.col("rx") * F.col("cy")).otherwise(0)).alias("agree"), F.sum(F.pow(F.col("x") - F.col("y"), 2) * F.col("rx") * F.col("cy")).alias("apart")
    )
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("agreed"), F.sum(F.pow(F.col("x") - F.col("y"), 2) * F.col("n")).alias("off"))
    both = seen.join(chance)
    po, pe = F.col("agreed") / F.col("n"), F.col("agree") / (F.col("n") * F.col("n"))
    return both.select(
        "n", "agreed", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), F.when(F.col("apart") > 0, 1 - F.col("off") * F.col("n") / F.col("apart")).alias("kappa_quadratic")
    )
