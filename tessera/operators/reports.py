"""Reports: audits of joins and labels, observations of result lists, comparisons of tables and experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import company, family, key_tokens, mentions, menu_key, same_menu
from tessera.operators.joins import last_per_key
from tessera.operators.profile import quantiles
from tessera.operators.ranking import label
from tessera.schema import UNKNOWN


def _some(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# --- joins


def join_report(units: DataFrame, labels: DataFrame, rows: DataFrame, key: str, codes: str, code: str) -> DataFrame:
    """One row of counts over ``units`` and ``labels`` (key, and an array ``codes``) and ``rows`` (code), and ``is_clean``.

    Units whose code list differs from their label's, codes that the rows lack, and rows that no unit lists (which alone do
    not make a join unclean) are counted once each.
    """
    side = lambda df, name: df.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.max(F.array_sort(codes)).alias(f"codes_{name}"))
    both = side(units, "u").join(side(labels, "l"), key, "full")
    counts = both.agg(
        F.coalesce(F.sum("n_u"), F.lit(0)).alias("num_units"),
        F.coalesce(F.sum("n_l"), F.lit(0)).alias("num_labels"),
        _some(F.col("n_u").isNotNull() & F.col("n_l").isNotNull()).alias("num_joined"),
        _some(F.col("n_u") > 1).alias("duplicate_unit_ids"),
        _some(F.col("n_l") > 1).alias("duplicate_label_ids"),
        _some(F.col("n_l").isNull()).alias("units_without_label"),
        _some(F.col("n_u").isNull()).alias("labels_without_unit"),
        _some(F.col("codes_u") != F.col("codes_l")).alias("codelist_mismatch"),
    )
    listed = units.select(F.explode(codes).alias(code)).distinct()
    known = rows.select(code).distinct()
    out = counts.join(rows.agg(F.count("*").alias("num_foods")))
    out = out.join(listed.join(known, code, "left_anti").agg(F.count("*").alias("codes_missing_in_foods")))
    out = out.join(known.join(listed, code, "left_anti").agg(F.count("*").alias("codes_not_labeled")))
    dirty = ("duplicate_unit_ids", "duplicate_label_ids", "units_without_label", "labels_without_unit", "codelist_mismatch", "codes_missing_in_foods")
    return out.withColumn("is_clean", sum((F.col(c) for c in dirty[1:]), F.col(dirty[0])) == 0)


def same_order(a: DataFrame, b: DataFrame, id_: str, position: str) -> DataFrame:
    """One row: how many positions hold different ids, or are in one table only, and whether the tables agree in order."""
    left, right = a.select(position, F.col(id_).alias("_a"), F.lit(1).alias("_l")), b.select(position, F.col(id_).alias("_b"), F.lit(1).alias("_r"))
    differ = left.join(right, position, "full").agg(_some(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_differ"))
    return differ.withColumn("same", F.col("n_differ") == 0)


def ordered_distinct(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The first row of each key by ``position``, which keeps the input's order."""
    first = F.min_by(F.struct(*(c for c in df.columns)), position).alias("_r")
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(first).select("_r.*")


# --- labels


def label_quality(log: DataFrame, sheet: DataFrame, key: str, order: str, attributes: Sequence[str], mode: str = "live", reviewed=("approved", "corrected")) -> DataFrame:
    """``metric, attribute, value, state``: format-error and conflict rates, unknown share and reviewers' agreement per attribute.

    ``log``: status, mode, flags and ``labels`` (map) per attempt; ``sheet``: review, model_<a>, review_<a>.  Without
    attempts, successes or reviews a value is null and its state says so, instead of 0.
    """
    live = log.filter(F.col("mode") == mode)
    tried = live.agg(F.countDistinct(key).alias("n"), F.countDistinct(F.when(F.col("status") == "validation_failed", F.col(key))).alias("bad"))
    good = last_per_key(live, key, order).filter("status = 'success'")
    unknown = [_some(F.coalesce(F.col("labels")[a], F.lit(UNKNOWN)) == UNKNOWN).alias(f"u{i}") for i, a in enumerate(attributes)]
    made = good.agg(F.count("*").alias("good"), _some(F.array_contains("flags", "temperature conflict")).alias("conflicts"), *unknown)
    done = sheet.filter(F.col("review").isin(*reviewed))
    agreed = [_some(F.coalesce(f"review_{a}", f"model_{a}").eqNullSafe(F.col(f"model_{a}"))).alias(f"a{i}") for i, a in enumerate(attributes)]
    seen = done.agg(F.count("*").alias("done"), *agreed)

    def entry(metric: str, attribute: str | None, part: str, whole: str, without: str) -> Column:
        ran = F.col(whole) > 0
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(attribute).cast("string").alias("attribute"), F.when(ran, F.round(F.col(part) / F.col(whole), 4)).alias("value"),
            F.when(ran, F.lit("run")).otherwise(F.lit(without)).alias("state"),
        )

    rows = [entry("format_error", None, "bad", "n", "not run"), entry("conflict", None, "conflicts", "good", "not run")]
    rows += [entry("unknown", a, f"u{i}", "good", "not run") for i, a in enumerate(attributes)]
    rows += [entry("agreement", a, f"a{i}", "done", "not reviewed") for i, a in enumerate(attributes)]
    return tried.join(made).join(seen).select(F.inline(F.array(*rows)))


def label_distribution(records: DataFrame, attributes: Sequence[str], labels: str = "labels") -> DataFrame:
    """``attribute, value, n, share`` of every label, missing ones as unknown."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), label(F.col(labels), a).alias("value")) for a in attributes))
    counts = records.select(F.inline(pairs)).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("attribute")))


def estimated_tokens(texts: DataFrame, text: str, fixed_chars: int, chars_a_token: float) -> DataFrame:
    """One row: texts, their mean length, and the tokens that a request of each would take, with a prompt of fixed length."""
    out = texts.agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"))
    mean = F.col("chars") / F.greatest("n", F.lit(1))
    return out.select("n", mean.alias("mean_chars"), ((F.col("chars") + F.col("n") * fixed_chars) / chars_a_token).alias("tokens"))


# --- result lists


def observe_lists(found: DataFrame) -> DataFrame:
    """What can be seen of each result list of ``recommend_all``: returned, violations, unknown, mismatched, duplicates, repeated
    records and families, widenings, the last range and how many were filtered out."""
    items = F.transform("selected", lambda s: s["row"])
    value = lambda it, c: label(it["labels"], c["attribute"])
    fails = lambda it, c: ~F.array_contains(c["allowed"], value(it, c))
    total = lambda each: F.coalesce(F.aggregate(F.transform("_items", each), F.lit(0), lambda a, n: a + n), F.lit(0))
    terms = F.transform("p.menu_exclusions", lambda e: e["term"])
    table = found.withColumn("_items", items)
    keys = F.transform(
        "_items", lambda it: F.struct(menu_key(it["name"]).alias("key"), company(it["company"]).alias("company"), key_tokens(it["name"]).alias("parts"))
    )
    table = table.withColumn("_keys", keys)
    earlier = lambda k, i: F.exists(F.slice("_keys", F.lit(1), i), lambda other: same_menu(k, other))
    doubles = F.size(F.filter("_keys", lambda k, i: F.when(i > 0, earlier(k, i)).otherwise(F.lit(False))))
    repeated = lambda of: F.size("_items") - F.size(F.array_distinct(F.transform("_items", of)))
    none = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("int")
    return table.select(
        "query",
        "status",
        none(F.size("_items")).alias("returned"),
        (
            total(lambda it: F.size(F.filter("p.hard", lambda c: fails(it, c)))) + total(lambda it: F.size(F.filter(terms, lambda t: mentions(t, it["name"], it["representative"], it["category"]))))
        ).alias("violations"),
        total(lambda it: F.exists(F.concat("p.hard", "p.soft"), lambda c: value(it, c) == UNKNOWN).cast("int")).alias("unknown"),
        total(lambda it: F.size(F.filter("p.soft", lambda c: fails(it, c) & (value(it, c) != UNKNOWN)))).alias("mismatched"),
        none(doubles).alias("duplicates"),
        none(repeated(lambda it: it["representative"])).alias("repeated"),
        none(repeated(lambda it: family(it["representative"], it["company"]))).alias("repeated_families"),
        none(F.size("trail") - 1).alias("widened_times"),
        F.coalesce(F.element_at("trail", -1), F.lit(0)).alias("range"),
        none(F.col("n_candidates") - F.col("n_kept")).alias("filtered_out"),
    )


def repeats_within(items: DataFrame, by: str, position: str, name: str, company_: Column | None = None) -> DataFrame:
    """``by, returned, duplicates``: items of each list that name a variant of one before them.  Lists are a result's, and short."""
    owner = F.lit("") if company_ is None else company(company_)
    entry = F.struct(F.col(position).alias("at"), menu_key(F.col(name)).alias("key"), owner.alias("company"), key_tokens(F.col(name)).alias("parts"))
    lists = items.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    again = F.filter("_l", lambda k, i: F.when(i > 0, F.exists(F.slice("_l", F.lit(1), i), lambda other: same_menu(k, other))).otherwise(F.lit(False)))
    return lists.select(by, F.size("_l").alias("returned"), F.size(again).alias("duplicates"))


def rendered(items: DataFrame, by: str, rank: str, text: Column, k: int = 5) -> DataFrame:
    """``by, line``: the first k items of each list on one line, in order."""
    entry = F.when(F.col(rank) <= k, F.struct(F.col(rank).alias("r"), F.concat(F.col(rank).cast("string"), F.lit(". "), text).alias("t")))
    return items.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), " | ").alias("line"))


def changed_lists(a: DataFrame, b: DataFrame, by: str, id_: str, rank: str, k: int = 5) -> DataFrame:
    """``by, common, same_set, same_order`` of two result tables' first k items."""
    ids = lambda df, name: df.filter(F.col(rank) <= k).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, id_))), lambda x: x[id_]).alias(name))
    kind = dict(a.dtypes)[id_]
    none = F.array().cast(f"array<{kind}>")
    both = ids(a, "_a").join(ids(b, "_b"), by, "full").withColumns({"_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    common = F.size(F.array_intersect("_a", "_b"))
    return both.select(by, common.alias("common"), (F.array_sort("_a") == F.array_sort("_b")).alias("same_set"), (F.col("_a") == F.col("_b")).alias("same_order"))


def similarity_spread(found: DataFrame, by: str, k: int) -> DataFrame:
    """One row: queries, mean similarity of the first, mean and largest gap between the first and the k-th."""
    per = found.groupBy(by).agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top"), F.max(F.when(F.col("rank") == k, F.col("sim"))).alias("last"))
    exact = lambda c: c.cast("decimal(20,9)")
    gap = exact(F.col("top")) - exact(F.col("last"))
    mean = lambda c: F.sum(c).cast("double") / F.count(c)
    return per.agg(F.count("*").alias("n_queries"), mean(exact(F.col("top"))).alias("mean_top"), mean(gap).alias("mean_gap"), F.max(gap).cast("double").alias("max_gap"))


def variant_observation(found: DataFrame, by: str, text: Column, word: str, group: str, k: int = 5) -> DataFrame:
    """``by, share, repeated``: the share of the first k texts that hold a word, and how many repeat a group before them."""
    top = found.filter(F.col("rank") <= k)
    return top.groupBy(by).agg(F.avg(F.contains(text, F.lit(word)).cast("int")).alias("share"), (F.count("*") - F.countDistinct(group)).alias("repeated"))


def parser_coverage(parsed: DataFrame, p: str = "p") -> DataFrame:
    """One row: texts, and how many have a condition, a hard one, a menu, a context, something unhandled."""
    has = lambda part: F.size(f"{p}.{part}") > 0
    return parsed.agg(
        F.count("*").alias("n"), _some(has("hard") | has("soft")).alias("with_condition"), _some(has("hard")).alias("with_hard"), _some(has("menu_terms")).alias("with_menu"),
        _some(has("ignored")).alias("with_context"), _some(has("unhandled")).alias("with_unhandled"),
    )


def condition_kind(hard: Column, soft: Column) -> Column:
    """The bucket of a query: hard conditions, preferences only, or none."""
    return F.when(F.size(hard) > 0, "hard").when(F.size(soft) > 0, "soft").otherwise("none")


def mean_by(metrics: DataFrame, bucket: str, columns: Sequence[str]) -> DataFrame:
    """``bucket, n`` and the mean of each column, nulls left out; sums are exact."""
    mean = lambda c: (F.sum(F.col(c).cast("decimal(20,9)")).cast("double") / F.count(c)).alias(c)
    return metrics.groupBy(bucket).agg(F.count("*").alias("n"), *(mean(c) for c in columns))


def seed_means(runs: DataFrame, model: str, split: str, columns: Sequence[str]) -> DataFrame:
    """``model, split`` and the mean over seeds of each column; a seed without a value is left out."""
    mean = lambda c: (F.sum(F.col(c).cast("decimal(20,9)")).cast("double") / F.count(c)).alias(c)
    return runs.groupBy(model, split).agg(F.count("*").alias("n_seeds"), *(mean(c) for c in columns))


# --- tables


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "group_size") -> DataFrame:
    """``df`` with the number of rows of each row's key: a pre-aggregated count joined back, so no group is gathered."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name)).select(*(F.col(k).alias(f"_{k}") for k in keys), name)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(counts, same).drop(*(f"_{k}" for k in keys))


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n, mean, sd, low, high`` and exact quartiles of numeric columns."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))))
    whole = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))
    named = lambda f, name: F.max(F.when(F.col("fraction") == f, F.col("value"))).alias(name)
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(named(0.25, "q1"), named(0.5, "q2"), named(0.75, "q3"))
    return whole.join(quarters, "column", "left").select("column", "n", "mean", "sd", "low", "q1", "q2", "q3", "high")


def compare_tables(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, rows_before, rows_after, missing_before, missing_after``: two profiles side by side."""

    def profile(df: DataFrame, name: str) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("int").alias("gone")) for c in columns))
        return df.select(F.inline(parts)).groupBy("column").agg(F.count("*").alias(f"rows_{name}"), F.sum("gone").alias(f"missing_{name}"))

    return profile(before, "before").join(profile(after, "after"), "column", "full")


def found_counts(df: DataFrame, text: str, pattern: str, group: int = 0) -> DataFrame:
    """``found, n``: everything that a pattern finds in a column of texts, counted."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))
    return df.select(F.explode(hits).alias("found")).groupBy("found").agg(F.count("*").alias("n"))


def wide_to_long(df: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    """``id_, attribute, value``: one row per column, values as texts."""
    return df.select(id_, F.inline(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns))))


def long_to_wide(df: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    """One column per attribute again; of repeated pairs the smallest value counts."""
    return df.groupBy(id_).pivot("attribute", list(columns)).agg(F.min("value"))


def prompt_json(columns: Sequence[str]) -> Column:
    """The input of a prompt: the columns as one JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
