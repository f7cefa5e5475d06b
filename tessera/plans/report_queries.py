"""More queries of the engine with their SQL: reports, comparisons, and sources written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vector import dot
from tessera.operators import cleaning, evaluation, reports
from tessera.plans.catalogue import _ATTEMPTS, _GRADED, _KNN, ASKED, ASKED_NUMBER, _asked_texts, _attempts, _found, _grades, _neighbours, drawn, query, recommended, table
from tessera.plans.parser import parse_column
from tessera.sources import tables
from tessera.sources.vector_store import VectorStore
from tessera.streaming import feedback

# --- joins and orders

_UNITS = """u AS (SELECT o_custkey AS k, list_sort(list(o_orderkey)) AS codes FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1),
uu AS (SELECT * FROM u UNION ALL SELECT * FROM u WHERE k % 10 = 0), l AS (SELECT o_custkey AS k, list_sort(list(o_orderkey)) AS codes FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
f AS (SELECT o_orderkey AS code FROM orders WHERE o_orderkey % 7 <> 0), c AS (SELECT DISTINCT unnest(codes) AS code FROM u)"""


@query(
    f"""WITH {_UNITS}, s AS (SELECT (SELECT count(*) FROM uu) AS num_units, (SELECT count(*) FROM l) AS num_labels, (SELECT count(*) FROM u JOIN l USING (k)) AS num_joined,
  (SELECT count(*) FROM u WHERE k % 10 = 0) AS duplicate_unit_ids, 0::BIGINT AS duplicate_label_ids, (SELECT count(*) FROM u ANTI JOIN l USING (k)) AS units_without_label,
  (SELECT count(*) FROM l ANTI JOIN u USING (k)) AS labels_without_unit, (SELECT count(*) FROM u JOIN l USING (k) WHERE u.codes <> l.codes) AS codelist_mismatch, (SELECT count(*) FROM f) AS num_foods,
  (SELECT count(*) FROM c ANTI JOIN f USING (code)) AS codes_missing_in_foods, (SELECT count(*) FROM f ANTI JOIN c USING (code)) AS codes_not_labeled)
SELECT *, duplicate_unit_ids + units_without_label + labels_without_unit + codelist_mismatch + codes_missing_in_foods = 0 AS is_clean FROM s"""
)
def three_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, labels and rows audited against each other: repeated ids, missing sides, differing lists, unlisted codes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("code"))
    listed = lambda df: df.groupBy("k").agg(F.collect_list("code").alias("codes"))
    units = listed(orders.filter("code % 5 <> 0"))
    return reports.join_report(units.unionByName(units.filter("k % 10 = 0")), listed(orders.filter("k % 4 <> 0")), orders.filter("code % 7 <> 0"), "k", "codes", "code")


@query("SELECT count(*) FILTER (event_id % 97 = 0) AS n_differ, count(*) FILTER (event_id % 97 = 0) = 0 AS same FROM events")
def ordered_ids_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two tables hold the same ids in the same order."""
    a = table(spark, sf_dir, "events").select("event_id", "user_id")
    b = a.withColumn("user_id", F.when(F.col("event_id") % 97 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id")))
    return reports.same_order(a, b, "user_id", "event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def ordered_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ordered_distinct(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS group_size FROM lineitem")
def group_size_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_group_size(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])


# --- labels

_SHEET = """h AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'corrected' END AS review, quality::VARCHAR AS model_a,
  CASE WHEN doc_id % 2 = 0 THEN toxic::VARCHAR END AS review_a, toxic::VARCHAR AS model_b, CASE WHEN doc_id % 5 = 0 THEN quality::VARCHAR END AS review_b FROM labels),
d AS (SELECT * FROM h WHERE review <> 'pending'), g AS (SELECT *, CASE WHEN k > 50 THEN 'high' WHEN k > 20 THEN 'low' END AS a, CASE WHEN k % 2 = 0 THEN 'even' END AS b FROM l WHERE status = 'success')"""


@query(
    f"""WITH {_ATTEMPTS}, {_SHEET}, m AS (
SELECT 'format_error' AS metric, NULL AS attribute, round(count(DISTINCT CASE WHEN status = 'validation_failed' THEN user_id END) / count(DISTINCT user_id)::DOUBLE, 4) AS value FROM a WHERE mode = 'live'
UNION ALL SELECT 'conflict', NULL, round(count(*) FILTER (k > 75) / count(*)::DOUBLE, 4) FROM g
UNION ALL SELECT 'unknown', 'a', round(count(*) FILTER (a IS NULL) / count(*)::DOUBLE, 4) FROM g UNION ALL SELECT 'unknown', 'b', round(count(*) FILTER (b IS NULL) / count(*)::DOUBLE, 4) FROM g
UNION ALL SELECT 'agreement', 'a', round(count(*) FILTER (coalesce(review_a, model_a) = model_a) / count(*)::DOUBLE, 4) FROM d
UNION ALL SELECT 'agreement', 'b', round(count(*) FILTER (coalesce(review_b, model_b) = model_b) / count(*)::DOUBLE, 4) FROM d)
SELECT *, CASE WHEN value IS NOT NULL THEN 'run' WHEN metric = 'agreement' THEN 'not reviewed' ELSE 'not run' END AS state FROM m"""
)
def label_quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, conflict, unknown and agreement rates of labels, per attribute."""
    k = F.col("output_tokens")
    labels = F.create_map(F.lit("a"), F.when(k > 50, "high").when(k > 20, "low"), F.lit("b"), F.when(k % 2 == 0, "even"))
    key, text = F.col("doc_id"), lambda c: F.col(c).cast("string")
    sheet = table(spark, sf_dir, "labels").select(
        F.when(key % 3 == 0, "pending").when(key % 3 == 1, "approved").otherwise("corrected").alias("review"),
        text("quality").alias("model_a"), F.when(key % 2 == 0, text("toxic")).alias("review_a"), text("toxic").alias("model_b"), F.when(key % 5 == 0, text("quality")).alias("review_b"),
    )
    return reports.label_quality(_attempts(spark, sf_dir).withColumn("labels", labels), sheet, "user_id", "event_id", ["a", "b"])


@query(
    """WITH p AS (SELECT 'lang' AS attribute, coalesce(nullif(lang, ''), '미확인') AS value FROM documents UNION ALL SELECT 'source', coalesce(nullif(source, ''), '미확인') FROM documents),
c AS (SELECT attribute, value, count(*) AS n FROM p GROUP BY 1, 2) SELECT attribute, value, n, n / (sum(n) OVER (PARTITION BY attribute))::DOUBLE AS share FROM c"""
)
def label_value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("labels"))
    return reports.label_distribution(rows, ["lang", "source"])


@query("SELECT count(*) AS n, sum(length(coalesce(text, '')))::DOUBLE / count(*) AS mean_chars, (sum(length(coalesce(text, ''))) + count(*) * 350)::DOUBLE / 2.5::DOUBLE AS tokens FROM documents")
def prompt_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.estimated_tokens(table(spark, sf_dir, "documents"), "text", 350, 2.5)


@query("SELECT p_partkey, to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_type': nullif(p_type, 'PROMO')})::VARCHAR AS prompt FROM part")
def prompt_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.nullif("p_type", F.lit("PROMO")).alias("p_type"))
    return rows.select("p_partkey", reports.prompt_json(["p_partkey", "p_name", "p_type"]).alias("prompt"))


# --- result lists


@query(
    """WITH r AS (SELECT p_brand, string_split(p_name, ' ') AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
t AS (SELECT * FROM r WHERE n <= 8)
SELECT p_brand, count(*)::INTEGER AS returned, count(*) FILTER (EXISTS (SELECT 1 FROM t AS b WHERE b.p_brand = a.p_brand AND b.n < a.n AND b.w[:least(len(a.w), len(b.w))] = a.w[:least(len(a.w), len(b.w))]))::INTEGER AS duplicates
FROM t AS a GROUP BY p_brand"""
)
def duplicates_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each brand's eight dearest parts name a variant of a dearer one."""
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    top = table(spark, sf_dir, "part").withColumn("n", F.row_number().over(order)).filter("n <= 8")
    return reports.repeats_within(top, "p_brand", "n", "p_name")


@query(f"WITH {_KNN} SELECT query_id, string_agg(rank || '. ' || vec_id || ' (' || label || ')', ' | ' ORDER BY rank) AS line FROM r WHERE rank <= 5 GROUP BY query_id")
def rendered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).withColumnRenamed("query", "query_id")
    return reports.rendered(found, "query_id", "rank", F.concat(F.col("id").cast("string"), F.lit(" ("), F.col("label").cast("string"), F.lit(")")))


@query(
    f"""WITH {_KNN}, a AS (SELECT query_id, list(vec_id ORDER BY rank) AS x FROM r WHERE rank <= 5 GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE label <= 6), b AS (SELECT query_id, list(vec_id ORDER BY n) AS y FROM f WHERE n <= 5 GROUP BY 1),
t AS (SELECT query_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b USING (query_id))
SELECT query_id, len(list_intersect(x, y))::INTEGER AS common, list_sort(x) = list_sort(y) AS same_set, x = y AS same_order FROM t"""
)
def changed_result_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the first five neighbours change under a filter."""
    vectors = table(spark, sf_dir, "embeddings")
    from tessera.operators.ranking import top_k_similar

    kept = top_k_similar(vectors.filter(ASKED), vectors.filter("label <= 6"), 5, "vec_id", "vec_id", exclude_self=True)
    return reports.changed_lists(_neighbours(spark, sf_dir, 5), kept, "query_id", "vec_id", "rank")


@query(
    f"""WITH {_KNN}, g AS (SELECT query_id, max(sim::DECIMAL(20, 9)) FILTER (rank = 1) AS a, max(sim::DECIMAL(20, 9)) FILTER (rank = 20) AS b FROM r GROUP BY query_id)
SELECT count(*) AS n_queries, sum(a)::DOUBLE / count(a) AS mean_top, sum(a - b)::DOUBLE / count(a - b) AS mean_gap, max(a - b)::DOUBLE AS max_gap FROM g"""
)
def similarity_spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.similarity_spread(_neighbours(spark, sf_dir, 20), "query_id", 20)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_type, avg(contains(p_name, 'ring')::INT) AS share, count(*) - count(DISTINCT p_brand) AS repeated FROM r WHERE rank <= 5 GROUP BY p_type"""
)
def text_variant_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return reports.variant_observation(table(spark, sf_dir, "part").withColumn("rank", F.row_number().over(order)), "p_type", F.col("p_name"), "ring", "p_brand")


@query(
    f"""WITH {_KNN}, {_GRADED}, t AS (SELECT r.query_id, r.q_label, r.rank, coalesce(j.grade, 0) AS g FROM r LEFT JOIN j USING (query_id, vec_id) WHERE rank <= 5),
m AS (SELECT query_id, CASE WHEN any_value(q_label) < 3 THEN 'hard' WHEN any_value(q_label) < 6 THEN 'soft' ELSE 'none' END AS kind, count(*) FILTER (g >= 2) / 5.0::DOUBLE AS precision,
  coalesce(max(CASE WHEN g >= 2 THEN 1.0::DOUBLE / rank END), 0) AS rr FROM t GROUP BY query_id)
SELECT kind, count(*) AS n, sum(precision::DECIMAL(20, 9))::DOUBLE / count(*) AS precision, sum(rr::DECIMAL(20, 9))::DOUBLE / count(*) AS rr FROM m GROUP BY kind"""
)
def metrics_by_condition_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean precision and reciprocal rank of queries with hard conditions, preferences only, or none."""
    found = _found(spark, sf_dir)
    some = lambda on: F.when(on, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    kinds = found.select("query", reports.condition_kind(some(F.col("q_label") < 3), some(F.col("q_label") < 6)).alias("kind")).distinct()
    return reports.mean_by(evaluation.per_query(found, _grades(found), 5).join(kinds, "query"), "kind", ["precision", "rr"])


@query(
    f"""WITH {_KNN}, x AS (SELECT query_id, (max(sim) FILTER (rank = 1) - max(sim) FILTER (rank = 5))::DECIMAL(20, 9) AS diff FROM r WHERE q_label < 6 GROUP BY query_id),
{drawn("x", 1000, 7)}, o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m),
e AS (SELECT max(m) FILTER (r = 25) AS low, max(m) FILTER (r = 974) AS high FROM o)
SELECT (SELECT sum(diff)::DOUBLE / count(*) FROM x) AS mean_diff, (SELECT count(*) FROM x) AS n, low, high, low <= 0 AND high >= 0 AS holds_zero FROM e"""
)
def subpopulation_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of a mean difference over some of the queries."""
    found = _found(spark, sf_dir).filter("q_label < 6").select("query", "id", "rank").join(_neighbours(spark, sf_dir, 5).select(F.col("query_id").alias("query"), F.col("vec_id").alias("id"), "sim"), ["query", "id"])
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("sim")))
    return evaluation.paired_bootstrap(found.groupBy("query").agg((at(1) - at(5)).alias("diff")), 1000, 7)


@query(
    """SELECT p_type, p_brand, count(*) AS n_seeds, sum((CASE WHEN p_size <= 45 THEN p_retailprice END)::DECIMAL(20, 9))::DOUBLE / count(CASE WHEN p_size <= 45 THEN p_retailprice END) AS price,
  sum(p_size::DECIMAL(20, 9))::DOUBLE / count(p_size) AS p_size FROM part GROUP BY p_type, p_brand"""
)
def seed_mean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_size") <= 45, F.col("p_retailprice")))
    return reports.seed_means(runs, "p_type", "p_brand", ["price", "p_size"])


@query()
def recommendation_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, unknown labels, mismatches, duplicates, repeats and widenings of every recommendation."""
    return reports.observe_lists(recommended(spark, sf_dir))


@query(
    f"""WITH q AS (SELECT {ASKED_NUMBER} AS i FROM conversations)
SELECT count(*) AS n, count(*) FILTER (i IN (0, 2, 3, 5, 6, 7, 8, 9, 10, 12, 13)) AS with_condition, count(*) FILTER (i IN (0, 2, 3, 7, 10)) AS with_hard, count(*) FILTER (i IN (4, 8, 9, 12)) AS with_menu,
  count(*) FILTER (i IN (5, 12, 15)) AS with_context, count(*) FILTER (i IN (1, 6, 11)) AS with_unhandled FROM q"""
)
def parser_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parser_coverage(_asked_texts(spark, sf_dir).select(parse_column(F.col("asked")).alias("p")))


# What each of the sentences (by number) asks for: kind, attribute, values, words, rule.
_CONDITIONS = (
    (0, "hard", "매운맛", "없음", "맵지 않고", "매운맛_제외"),
    (0, "soft", "국물", "국물요리", "국물", "국물"),
    (0, "soft", "제공온도", "뜨거움/따뜻함", "따뜻한", "따뜻함"),
    (2, "hard", "매운맛", "보통/강함", "매운", "매운맛"),
    (3, "hard", "매운맛", "없음", "매운 거 싫어", "매운맛_제외"),
    (5, "soft", "매운맛", "보통/강함", "얼큰한", "얼큰"),
    (5, "soft", "제공온도", "뜨거움/따뜻함", "얼큰한", "얼큰"),
    (5, "soft", "국물", "국물요리", "국물", "국물"),
    (6, "soft", "매운맛", "보통/강함", "얼큰한", "얼큰"),
    (7, "hard", "매운맛", "없음", "맵지 않은", "매운맛_제외"),
    (8, "soft", "매운맛", "약함/보통", "살짝 매운", "매운맛_약함"),
    (9, "soft", "계열", "한식", "밥", "밥_한식"),
    (10, "hard", "조리법", "끓임/볶음/구이/찜/조림/부침/오븐/비조리/혼합", "튀김 말고", "튀김_제외"),
    (10, "soft", "기름짐", "낮음", "담백한", "담백"),
    (10, "soft", "매운맛", "없음/약함", "담백한", "담백"),
    (10, "soft", "계열", "한식", "한식", "계열_한식"),
    (12, "soft", "국물", "국물요리", "찌개", "국물"),
    (12, "soft", "든든함", "든든함", "든든한", "든든함"),
    (13, "soft", "조리법", "튀김", "바삭한, 튀김", "튀김, 튀김"),
    (13, "soft", "안주", "예", "안주", "안주"),
)


@query(
    f"""WITH s(i, strength, attribute, allowed, evidence, rule) AS (VALUES {", ".join(str(c) for c in _CONDITIONS)})
SELECT conv_id, turn, strength, attribute, allowed, evidence, rule FROM conversations JOIN s ON i = {ASKED_NUMBER}"""
)
def query_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every condition of every text as a row."""
    parsed = _asked_texts(spark, sf_dir).select("conv_id", "turn", parse_column(F.col("asked")).alias("p"))
    said = parsed.select("conv_id", "turn", F.explode(F.concat("p.hard", "p.soft")).alias("c"))
    return said.select("conv_id", "turn", "c.strength", "c.attribute", F.array_join("c.allowed", "/").alias("allowed"), "c.evidence", "c.rule")


@query(
    f"""WITH {_KNN}, {_GRADED}, runs(model, seed, step) AS (VALUES ('base', 0, 1), ('tuned', 1, 3), ('tuned', 2, 7), ('tuned', 3, 9)),
x AS (SELECT model, seed, query_id, vec_id, ((rank - 1) * step + seed) % 20 + 1 AS rank FROM r, runs WHERE rank <= 20),
y AS (SELECT x.*, grade FROM x LEFT JOIN j USING (query_id, vec_id)),
t AS (SELECT model, seed, query_id, count(*) FILTER (grade IS NULL) / count(*)::DOUBLE AS unjudged, sum((2.0::DOUBLE ** coalesce(grade, 0) - 1) / log2(rank + 1.0)) AS dcg FROM y WHERE rank <= 5 GROUP BY ALL),
c AS (SELECT model, seed, query_id, sum((2.0::DOUBLE ** grade - 1) / log2(p + 1.0)) AS own FROM (SELECT *, row_number() OVER (PARTITION BY model, seed, query_id ORDER BY rank) AS p FROM y WHERE grade IS NOT NULL) WHERE p <= 5 GROUP BY ALL),
h AS (SELECT model, seed, query_id, count(*) AS hits FROM y WHERE rank <= 10 AND grade = 2 GROUP BY ALL), b AS (SELECT query_id, count(*) AS n FROM j WHERE grade = 2 GROUP BY query_id)
SELECT model, seed, query_id AS query, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg, round(unjudged, 6) AS unjudged, round(CASE WHEN ideal > 0 THEN coalesce(own, 0) / ideal ELSE 0 END, 6) AS condensed,
  round(CASE WHEN n > 0 THEN coalesce(hits, 0) / least(10, n)::DOUBLE END, 6) AS recall
FROM t LEFT JOIN i USING (query_id) LEFT JOIN c USING (model, seed, query_id) LEFT JOIN h USING (model, seed, query_id) LEFT JOIN b USING (query_id)"""
)
def experiment_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base ranking and three seeds of another one, measured query by query."""
    found = _found(spark, sf_dir)
    runs = spark.createDataFrame([("base", 0, 1), ("tuned", 1, 3), ("tuned", 2, 7), ("tuned", 3, 9)], "model string, seed int, step int")
    place = ((F.col("rank") - 1) * F.col("step") + F.col("seed")) % 20 + 1
    results = found.filter("rank <= 20").join(F.broadcast(runs)).withColumn("rank", place).select("model", "seed", "query", "id", "rank")
    out = evaluation.experiment(results, _grades(found), ["model", "seed"])
    return out.withColumns({c: F.round(c, 6) for c in ("ndcg", "unjudged", "condensed", "recall")})


# --- tables


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, min({c})::DOUBLE AS low, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q2, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, max({c})::DOUBLE AS high FROM part"
        for c in ("p_size", "p_retailprice")
    )
)
def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.described(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "q1", "q2", "q3")})


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FILTER ({c} IS NULL) FROM orders) AS missing_before, count(*) AS rows_after, "
        f"count(*) FILTER (nullif({c}::VARCHAR, '4-NOT SPECIFIED') IS NULL) AS missing_after FROM orders WHERE o_orderstatus <> 'P'"
        for c in ("o_orderstatus", "o_orderpriority")
    )
)
def before_after_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    after = cleaning.sentinel_to_null(orders.filter("o_orderstatus <> 'P'"), ["o_orderpriority"], "4-NOT SPECIFIED")
    return reports.compare_tables(orders, after, ["o_orderstatus", "o_orderpriority"])


@query("SELECT found, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{3,}')) AS found FROM documents) GROUP BY found")
def found_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.found_counts(table(spark, sf_dir, "documents"), "text", "[A-Z][a-z]{3,}")


@query(" UNION ALL ".join(f"SELECT p_partkey, '{c}' AS attribute, {c}::VARCHAR AS value FROM part" for c in ("p_type", "p_brand", "p_size")))
def wide_to_long_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.wide_to_long(table(spark, sf_dir, "part"), "p_partkey", ["p_type", "p_brand", "p_size"])


@query("SELECT p_partkey, p_type, p_brand, p_size::VARCHAR AS p_size FROM part")
def long_to_wide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_to_wide(wide_to_long_parts(spark, sf_dir), "p_partkey", ["p_type", "p_brand", "p_size"])


# --- sources: written to the shared folder and read back


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, nullif(p_type, 'PROMO') AS p_type, NULL::VARCHAR AS note FROM part")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a missing and an extra column, read as texts; empty cells are null."""
    path = tables.shared_path(spark, "sheet")
    rows = table(spark, sf_dir, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    tables.write_sheet(rows, path, ["p_partkey", "p_name", "p_type", "note"])
    back = tables.read_csv(spark, path)
    return back.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in back.columns))


@query("SELECT event_id, event_type FROM events")
def log_append_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines appended in two goes; a path that is not there reads as an empty table."""
    path = tables.shared_path(spark, "log")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    before = tables.read_or_empty(spark, path, rows.schema)
    tables.append_jsonl(rows.filter("event_id % 2 = 0"), path)
    tables.append_jsonl(rows.filter("event_id % 2 = 1"), path)
    return tables.read_jsonl(spark, path, rows.schema).unionByName(before)


@query("SELECT 'now' AS state, count(*) FILTER (quality = 1) AS n FROM labels UNION ALL SELECT 'backup', count(*) FROM labels")
def replaced_table_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by another, and the backup of the one before."""
    path = tables.shared_path(spark, "reviews")
    rows = table(spark, sf_dir, "labels")
    tables.write_with_backup(rows, path)
    backup = tables.write_with_backup(rows.filter("quality = 1"), path)
    size = lambda name, p: spark.read.schema(rows.schema).parquet(p).agg(F.lit(name).alias("state"), F.count("*").alias("n"))
    return size("now", path).unionByName(size("backup", backup))


@query("SELECT vec_id::VARCHAR AS id, len(embedding)::INTEGER AS dim, label, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) ** 0.5, 4) AS along, 0.0::DOUBLE AS apart FROM embeddings WHERE label IS NOT NULL")
def vector_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors stored with a manifest, checked, and loaded again: how far each reaches along the vector that was given,
    which is that one's length, and how far aside of it, which is nothing."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    unit = vectors.withColumn("embedding", F.transform("embedding", lambda x: (x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))).cast("float")))
    store = VectorStore(spark, tables.shared_path(spark, "vectors"))
    back = store.get_or_compute("vectors-A", {"model": "given"}, lambda: unit).join(vectors.select("id", F.col("embedding").alias("given")), "id")
    double = lambda c: F.col(c).cast("array<double>")
    along, length = dot(double("embedding"), double("given")), dot(double("given"), double("given"))
    apart = F.sqrt(F.greatest(F.lit(0.0), length - along * along))
    return back.select("id", F.size("embedding").alias("dim"), "label", F.round(along, 4).alias("along"), F.round(apart, 2).alias("apart"))


@query("SELECT event_id, (event_type IN ('click', 'purchase'))::INTEGER AS liked, 0 AS chosen, 'web' AS place FROM events")
def migrated_feedback_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older feedback table, without the columns that came later, read as today's."""
    path = tables.shared_path(spark, "old-feedback")
    table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("click", "purchase").cast("int").alias("liked")).write.parquet(path)
    return tables.add_column_if_missing(feedback.normalized(spark.read.parquet(path)), "place", "string", "web").select("event_id", "liked", "chosen", "place")


@query("SELECT event_id, user_id FROM events")
def replayed_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt log that is sent twice, in overlapping parts, holds every attempt once."""
    path = tables.shared_path(spark, "attempts")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    for part in (rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 3 <> 1"), rows):
        feedback.append_once(part, path, "event_id")
    return spark.read.parquet(path)
