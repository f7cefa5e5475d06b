"""Quality control of labels: response checks, attempt logs, budgets and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import last_per_key
from tessera.schema import DOMAINS, UNKNOWN

REASON_LENGTH = 200
# Serving temperatures that agree with a temperature in the product's own name.
COMPATIBLE = {"HOT": ("뜨거움", "따뜻함"), "ICED": ("차가움",)}


def unfenced(text: Column) -> Column:
    """A response without code fences around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?m)^```(?:json)?\s*|\s*```$", ""))


def validate_responses(rows: DataFrame, text: str, code: str, temperature: str, domains: dict[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """``rows`` with labels (map), reason, flags and error; the first failing check is the error, and labels are then null.

    Checks: an object; the fields code, labels, reason; the expected code; an object of labels; each attribute present
    with an allowed value or unknown; a reason that is not blank.  Flags: attributes beyond the known ones, a reason cut
    to 200 characters, a temperature that disagrees with the name's.
    """
    body = F.try_parse_json(unfenced(F.col(text)))
    get = lambda path: F.try_variant_get("_v", path, "string")
    out = rows.withColumn("_v", body).withColumn("_kind", F.schema_of_variant("_v"))
    labels = F.from_json(get("$.labels"), "map<string,string>")
    out = out.withColumns({"_labels": labels, "_is_map": F.coalesce(F.ltrim(get("$.labels")).startswith("{"), F.lit(False)), "_code": get("$.code"), "_reason": get("$.reason"), "_has_labels": get("$.labels").isNotNull()})
    keys = F.coalesce(F.map_keys("_labels"), F.array().cast("array<string>"))
    checks = [
        F.when(F.col("_v").isNull(), F.lit("not JSON")),
        F.when(~F.col("_kind").startswith("OBJECT"), F.lit("not an object")),
        F.when(F.col("_code").isNull() | ~F.col("_has_labels") | F.col("_reason").isNull(), F.lit("missing field")),
        F.when(F.col("_code") != F.col(code).cast("string"), F.lit("other code")),
        F.when(~F.col("_is_map"), F.lit("labels are no object")),
    ]
    for attribute, values in domains.items():
        value = F.col("_labels")[attribute]
        checks.append(F.when(~F.array_contains(keys, attribute), F.lit(f"missing attribute: {attribute}")))
        checks.append(F.when(~F.coalesce(value.isin(*values, UNKNOWN), F.lit(False)), F.concat(F.lit(f"not allowed: {attribute}="), F.coalesce(value, F.lit("null")))))
    checks.append(F.when(F.trim("_reason") == "", F.lit("blank reason")))
    reason = F.trim("_reason")
    conflict = F.lit(False)
    if "제공온도" in domains:
        served = F.col("_labels")["제공온도"]
        for mark, agree in COMPATIBLE.items():
            conflict = conflict | ((F.col(temperature) == mark) & (served != UNKNOWN) & ~served.isin(*agree))
    flags = F.array_compact(
        F.array(
            F.when(F.size(F.array_except(keys, F.array(*map(F.lit, domains)))) > 0, F.lit("extra attributes")),
            F.when(F.length(reason) > REASON_LENGTH, F.lit("reason cut")),
            F.when(F.coalesce(conflict, F.lit(False)), F.lit("temperature conflict")),
        )
    )
    out = out.withColumn("error", F.coalesce(*checks))
    fine = F.col("error").isNull()
    known = F.map_filter("_labels", lambda k, _: k.isin(*domains))
    out = out.withColumns({"labels": F.when(fine, known), "reason": F.when(fine, F.substring(reason, 1, REASON_LENGTH)), "flags": F.when(fine, flags)})
    return out.drop("_v", "_kind", "_labels", "_is_map", "_code", "_reason", "_has_labels")


def result_set_check(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``kind, key``: expected keys that are missing, keys that occur twice or more, keys that were not expected."""
    counts = results.groupBy(key).agg(F.count("*").alias("n"))
    wanted = expected.select(key).distinct()
    part = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    return (
        part("missing", wanted.join(counts, key, "left_anti"))
        .unionByName(part("duplicate", counts.filter("n > 1")))
        .unionByName(part("unexpected", counts.join(wanted, key, "left_anti")))
    )


def latest_success(log: DataFrame, key: str, order: str, mode: str = "live") -> DataFrame:
    """The last successful attempt of each key in a mode."""
    return last_per_key(log.filter((F.col("mode") == mode) & (F.col("status") == "success")), key, order)


def review_sheet(sample: DataFrame, log: DataFrame, key: str, order: str, mode: str = "live") -> DataFrame:
    """``sample`` with status and review: not run, success to be reviewed, or the last attempt's failure."""
    last = last_per_key(log.filter(F.col("mode") == mode), key, order).select(key, F.col("status").alias("_s"), "cache_key", "error")
    out = sample.join(last, key, "left")
    review = F.when(F.col("_s").isNull(), "not_run").when(F.col("_s") == "success", "pending").otherwise("failed")
    error = F.when(F.col("_s") != "success", F.col("error"))
    return out.withColumns({"status": F.coalesce("_s", F.lit("not_run")), "review": review, "error": error}).drop("_s")


def run_summary(log: DataFrame, run: Column) -> DataFrame:
    """Rows per scope and status, with tokens and cost: of ``run`` and of all runs together."""
    scoped = log.withColumn("scope", F.explode(F.when(run, F.array(F.lit("run"), F.lit("all"))).otherwise(F.array(F.lit("all")))))
    return scoped.groupBy("scope", "status").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")
    )


def within_budget(planned: DataFrame, budget: float, order: list[Column], spent: str = "cost", ceiling: str = "max_cost", by: list[str] | None = None) -> DataFrame:
    """``planned`` with ``runs``: whether what ran before and the next call's largest cost fit the budget; once one does
    not, no later one runs.  The sum runs along one log (or one per ``by``), as calls are made one after another."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    before = F.coalesce(F.sum(spent).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    over = F.max((F.col("_before") + F.col(ceiling) > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return planned.withColumn("_before", before).withColumn("runs", over == 0).drop("_before")


def attempt_quality(log: DataFrame, key: str, order: str, flags: str = "flags", mode: str = "live") -> DataFrame:
    """One row: attempted and successful keys, share with a format error, share of successes with a temperature conflict."""
    live = log.filter(F.col("mode") == mode)
    last = last_per_key(live, key, order).agg(
        F.count(F.when(F.col("status") == "success", 1)).alias("successes"),
        F.count(F.when((F.col("status") == "success") & F.array_contains(flags, "temperature conflict"), 1)).alias("conflicts"),
    )
    tried = live.agg(F.countDistinct(key).alias("attempted"), F.countDistinct(F.when(F.col("status") == "validation_failed", F.col(key))).alias("format_errors"))
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return tried.join(last).select("attempted", "successes", share("format_errors", "attempted").alias("format_error_rate"), share("conflicts", "successes").alias("conflict_rate"))


def reviewer_agreement(sheet: DataFrame, attributes: Sequence[str], model: str = "model_{}", reviewer: str = "review_{}", states=("approved", "corrected")) -> DataFrame:
    """``attribute, rate, n``: how often the final value, the reviewer's or else the model's, is the model's."""
    done = sheet.filter(F.col("review").isin(*states))
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(model.format(a)).alias("m"), F.col(reviewer.format(a)).alias("r")) for a in attributes))
    long = done.select(F.inline(pairs))
    return long.groupBy("attribute").agg(F.round(F.avg(F.coalesce("r", "m").eqNullSafe(F.col("m")).cast("int")), 4).alias("rate"), F.count("*").alias("n"))


def estimated_cost(input_tokens: Column, output_tokens: Column, prices: tuple[float, float], batch: bool = False) -> Column:
    """Cost by prices per million tokens; a batch costs half."""
    return (input_tokens * prices[0] + output_tokens * prices[1]) / 1e6 * (0.5 if batch else 1.0)
