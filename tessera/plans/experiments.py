"""Judging pools and comparisons of recommenders and configurations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.evaluation import per_query, summary
from tessera.operators.reports import ordered_distinct
from tessera.plans.recommend import PipelineConfig, Recommender, item_rows

ITEMS = "pos long, recommender string, config string, query string, id string, name string, company string, representative string, category string, rank int, score double, status string"


def run_grid(recommenders: dict[str, Recommender], queries: Iterable[str], configs: dict[str, PipelineConfig], k: int = 5) -> DataFrame:
    """The top k of every recommender, configuration and query as one table (a few rows each)."""
    rows = []
    spark = next(iter(recommenders.values())).index.sparkSession
    for query in queries:
        for name, engine in recommenders.items():
            for label, config in configs.items():
                result = engine.recommend(query, replace(config, top_k=k))
                rows += [(len(rows) + i, name, label, query, *(r[c] for c in ("id", "name", "company", "representative", "category", "rank", "score")), result.status) for i, r in enumerate(item_rows(result))]
    return spark.createDataFrame(rows, ITEMS)


def build_pool(grid: DataFrame) -> DataFrame:
    """What is to be judged: each query's items once, as the first configuration that found them says, with their place."""
    return ordered_distinct(grid.select("query", "id", "name", "company", "representative", "category", "pos"), ["query", "id"], "pos")


def evaluate_grid(grid: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """Mean metrics per recommender and configuration over the queries that returned something."""
    keyed = grid.withColumn("_run", F.struct("recommender", "config"))
    # A run's queries are told apart by the run; the judgments are the same for all runs.
    runs = keyed.select("_run").distinct()
    named = lambda run, query: F.to_json(F.struct(run, query))
    results = keyed.select(named(F.col("_run"), F.col("query")).alias("query"), "id", "rank")
    judged = grades.join(F.broadcast(runs)).select(named(F.col("_run"), F.col("query")).alias("query"), "id", "grade")
    metrics = per_query(results, judged, k).join(keyed.select(named(F.col("_run"), F.col("query")).alias("query"), "recommender", "config").distinct(), "query")
    return summary(metrics, ["recommender", "config"])


def weight_grid(base: PipelineConfig, menu: Iterable[float], context: Iterable[float]) -> dict[str, PipelineConfig]:
    """Configurations of every menu and context weight."""
    menu, context = list(menu), list(context)
    return {f"menu={m}, context={c}": replace(base, ranking=replace(base.ranking, menu_match_weight=m, context_match_weight=c)) for m in menu for c in context}


def diversity_grid(base: PipelineConfig, caps: Iterable[int], penalties: Iterable[float]) -> dict[str, PipelineConfig]:
    """Configurations of every cap and penalty of a group."""
    caps, penalties = list(caps), list(penalties)
    return {f"cap={c}, penalty={p}": replace(base, ranking=replace(base.ranking, group_cap=c, group_penalty=p)) for c in caps for p in penalties}


def range_grid(base: PipelineConfig, ranges: Iterable[int]) -> dict[str, PipelineConfig]:
    """Configurations of every first search range."""
    return {f"candidates={k}": replace(base, candidate_k=k) for k in ranges}


def compare_first(grid: DataFrame, a: str, b: str) -> DataFrame:
    """``query, first_a, first_b, same``: whether two configurations agree on the first item."""
    top = grid.filter("rank = 1").groupBy("query").pivot("config", [a, b]).agg(F.first("id"))
    return top.select("query", F.col(f"`{a}`").alias("first_a"), F.col(f"`{b}`").alias("first_b"), F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")).alias("same"))
