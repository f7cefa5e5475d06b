"""The queries of the retrieval and ranking engine and the SQL that checks them.

Each query runs an operator over whole tables; each SQL text states the same result for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import company, compact_stamp, embedding_text, family, is_test_query, mentions, parse_name, parse_quantity, utc_stamp, words
from tessera.functions.vector import vector_stats
from tessera.operators import cleaning, evaluation, joins, labelqc, ordering, profile, sampling, variants
from tessera.operators.ranking import (
    RankingConfig, best_first, cap_per_group, drop_reasons, final_score, first_mention, pick_per_keyword, preference, reason_histogram, select_top_k, top_k_similar,
)
from tessera.plans.parser import parse_column, register_tags
from tessera.plans.recommend import PipelineConfig, observe, recommend_all, widening_ladder
from tessera.schema import DOMAINS, RECORD, UNKNOWN, Condition
from tessera.sources.snapshots import SnapshotTable
from tessera.sources.tables import shared_path, stored
from tessera.streaming import attempts, feedback

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import tessera.plans.report_queries  # noqa: F401  registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import tessera.plans.report_queries  # noqa: F401

    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval and ranking


#: Queries of the search: every vector whose id is divisible by 50, against all vectors.
ASKED = "vec_id % 50 = 0"


def _neighbours(spark: SparkSession, sf_dir: str, k: int, per: str | None = None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_similar(vectors.filter(ASKED), vectors, k, "vec_id", "vec_id", exclude_self=True, per=per)


_KNN = """
s AS (SELECT q.vec_id AS query_id, d.vec_id, d.label, q.label AS q_label,
             round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS sim
      FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)"""


@query(
    f"""WITH {_KNN},
k AS (SELECT *, 0.7 * sim + 0.3 * (CASE WHEN label IN (0, 1, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM r WHERE label BETWEEN 0 AND 6),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, sim DESC, vec_id) AS n FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, sim DESC, vec_id) AS pick FROM c WHERE n <= 2)
SELECT query_id, pick::INTEGER AS pick, vec_id, label::VARCHAR AS grp, round(score, 9) AS score FROM p WHERE pick <= 5"""
)
def flagship_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, hard filter, preference bonus and capped choice for every query vector.

    Within a label the score follows the similarity, so no more of a label than the cap lets through can be chosen: the
    search brings just those, from all vectors.
    """
    config = RankingConfig(collapse_duplicates=False)
    found = _neighbours(spark, sf_dir, config.group_cap, per="label")
    labels = F.create_map(F.lit("label"), F.col("label").cast("string"))
    hard = [Condition("label", tuple(map(str, range(7))))]
    soft = [Condition("label", ("0", "1", "2"), "soft")]
    kept = found.withColumn("labels", labels).filter(F.size(drop_reasons(F.col("labels"), hard)) == 0)
    scored = kept.withColumn("score", final_score(F.col("sim"), preference(F.col("labels"), soft)["score"], F.lit(False), F.lit(False), config))
    named = scored.withColumns({"name": F.col("vec_id").cast("string"), "representative": F.col("label").cast("string"), "company": F.lit("-")})
    chosen = select_top_k(named, 5, config, ["query_id"], id_="vec_id")
    out = chosen.select("query_id", F.posexplode("selected").alias("pos", "s"))
    return out.select("query_id", (F.col("pos") + 1).alias("pick"), F.col("s.id").alias("vec_id"), F.col("s.group").alias("grp"), F.round("s.score", 9).alias("score"))


@query(f"WITH {_KNN} SELECT query_id, vec_id, sim, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 10)


_HARD = [Condition("quality", ("1",)), Condition("lang", ("en", "de"))]


def _judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    labels = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("lang"), F.col("lang"))
    return rows.select("doc_id", drop_reasons(labels, _HARD).alias("reasons"))


_DROPPED = f"""
SELECT d.doc_id, CASE WHEN l.quality IS NULL OR l.quality <> 1 THEN 'quality=' || coalesce(l.quality::VARCHAR, '{UNKNOWN}') END AS a,
       CASE WHEN d.lang IS NULL OR d.lang NOT IN ('en', 'de') THEN 'lang=' || coalesce(nullif(d.lang, ''), '{UNKNOWN}') END AS b
FROM documents d LEFT JOIN labels l USING (doc_id)"""


@query(f"SELECT doc_id, a IS NULL AND b IS NULL AS kept, concat_ws(';', a, b) AS reasons FROM ({_DROPPED})")
def hard_filter_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents pass, and why the others do not; what is not labelled fails."""
    said = F.array_join(F.transform("reasons", lambda r: F.concat_ws("=", r["attribute"], r["value"])), ";")
    return _judged_documents(spark, sf_dir).select("doc_id", (F.size("reasons") == 0).alias("kept"), said.alias("reasons"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest([a, b]) AS reason FROM ({_DROPPED})) WHERE reason IS NOT NULL GROUP BY reason")
def drop_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reason_histogram(_judged_documents(spark, sf_dir))


@query(
    """WITH t AS (SELECT p_brand, p_partkey, p_retailprice / 2000 AS sim,
  ((p_type IN ('PROMO', 'STANDARD'))::INT + (p_size <= 15)::INT) / 2.0::DOUBLE AS pref FROM part),
s AS (SELECT *, 0.7 * sim + 0.3 * pref AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 9) DESC, round(sim, 9) DESC, p_partkey) AS pick FROM s)
SELECT p_brand, pick::INTEGER AS pick, p_partkey, pref, round(score, 9) AS score FROM r WHERE pick <= 3"""
)
def preference_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best parts of each brand by price and two preferences."""
    size = F.when(F.col("p_size") <= 15, "S").when(F.col("p_size") <= 35, "M").otherwise("L")
    labels = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), size)
    soft = [Condition("type", ("PROMO", "STANDARD"), "soft"), Condition("size", ("S",), "soft")]
    rows = table(spark, sf_dir, "part").withColumns({"sim": F.col("p_retailprice") / 2000, "pref": preference(labels, soft)["score"]})
    rows = rows.withColumn("score", final_score(F.col("sim"), F.col("pref"), F.lit(False), F.lit(False), RankingConfig()))
    best = Window.partitionBy("p_brand").orderBy(*best_first(id_="p_partkey"))
    rows = rows.withColumn("pick", F.row_number().over(best)).filter("pick <= 3")
    return rows.select("p_brand", "pick", "p_partkey", "pref", F.round("score", 9).alias("score"))


@query(
    """SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'ring') OR p_type = 'ring' THEN 'ring'
  WHEN list_contains(string_split(p_name, ' '), 'hot') OR p_type = 'hot' THEN 'hot' WHEN p_type = 'PROMO' THEN 'PROMO' END AS hit FROM part"""
)
def menu_mentions_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first excluded term that points at each part (null: the part stays)."""
    hit = first_mention(["ring", "hot", "PROMO"], F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("hit"))


@query(
    f"""WITH {_KNN},
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM c WHERE n <= 2)
SELECT query_id, pick::INTEGER AS pick, vec_id, label FROM p WHERE pick <= 10"""
)
def group_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours with at most two of a label, from all vectors."""
    found = _neighbours(spark, sf_dir, 2, per="label")
    return cap_per_group(found, 2, 10, "query_id", "label", [F.desc("sim"), F.asc("vec_id")]).select("query_id", "pick", "vec_id", "label")


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY p_brand, string_split(p_name, ' ')[-1] ORDER BY p_retailprice DESC, p_partkey) AS m FROM f WHERE n = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pick FROM g WHERE m <= 2)
SELECT p_brand, pick::INTEGER AS pick, p_partkey FROM p WHERE pick <= 5"""
)
def greedy_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts of each brand without variants of one name and with at most two of a kind, chosen in order."""
    # Of rows with one name only the first can be chosen.
    rows = cleaning.first_per_key(table(spark, sf_dir, "part"), ["p_brand", "p_name"], [F.desc("p_retailprice"), F.asc("p_partkey")])
    named = rows.select("p_brand", "p_partkey", F.col("p_name").alias("name"), F.col("p_name").alias("representative"), F.lit("-").alias("company"), F.col("p_retailprice").alias("score"))
    chosen = select_top_k(named.withColumn("sim", F.lit(0.0)), 5, RankingConfig(), ["p_brand"], id_="p_partkey")
    out = chosen.select("p_brand", F.posexplode("selected").alias("pos", "s"))
    return out.select("p_brand", (F.col("pos") + 1).alias("pick"), F.col("s.id").alias("p_partkey"))


@query(
    """WITH t AS (SELECT p_brand, p_partkey, p_type AS grp, p_retailprice / 1000.0::DOUBLE AS score FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY p_brand, grp ORDER BY round(score, 9) DESC, p_partkey) AS nth FROM t),
w AS (SELECT *, score - 0.05::DOUBLE * (nth - 1) AS worth FROM g)
SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY worth DESC, round(score, 9) DESC, p_partkey))::INTEGER AS pick, p_partkey, grp FROM w
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY worth DESC, round(score, 9) DESC, p_partkey) <= 8"""
)
def penalised_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts of each brand, where every one taken of a type makes the next of it worth less.

    Within a type the n-th best is taken with the penalty of the n - 1 before it, which is how SQL can say it.
    """
    config = RankingConfig(group_key="representative", group_cap=0, collapse_duplicates=False, group_penalty=0.05)
    parts = table(spark, sf_dir, "part").select(
        "p_brand", "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("representative"), F.lit("-").alias("company"), (F.col("p_retailprice") / 1000.0).alias("score"), F.lit(0.0).alias("sim")
    )
    out = select_top_k(parts, 8, config, ["p_brand"], id_="p_partkey").select("p_brand", F.posexplode("selected").alias("pos", "s"))
    return out.select("p_brand", (F.col("pos") + 1).alias("pick"), F.col("s.id").alias("p_partkey"), F.col("s.group").alias("grp"))


@query("SELECT string_split(p_name, ' ')[-1] AS family, count(*) AS n FROM part GROUP BY 1")
def last_token_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "part").select(family(F.col("p_name"), F.lit("-")).alias("family")), "family")


@query(
    f"""WITH {_KNN}, z AS (SELECT count(*) AS size FROM embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM r WHERE label IN (0, 1)),
n AS (SELECT query_id, max(CASE WHEN p = 5 THEN rank END) AS need, count(*) AS n FROM p GROUP BY query_id),
t AS (SELECT q.query_id, n.n, greatest(0, ceil(log2(coalesce(need, size) / 4.0)))::INTEGER AS steps, size
      FROM (SELECT DISTINCT query_id FROM r) q LEFT JOIN n USING (query_id), z)
SELECT query_id, steps, least(size, 4 * (1 << steps))::INTEGER AS range, least(coalesce(n, 0), 5)::INTEGER AS returned FROM t"""
)
def widening_ladder_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the search of each query widens, doubling from 4, until five neighbours pass."""
    vectors = table(spark, sf_dir, "embeddings")
    return widening_ladder(vectors.filter(ASKED), vectors, F.col("label").isin(0, 1), 5, 4, "vec_id", "vec_id", exclude_self=True)


@query(
    """SELECT p_brand, p_name AS keyword, p_partkey, round(p_retailprice / 1000, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1) WHERE pick <= 4"""
)
def pick_one_per_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("keyword", F.col("p_name"))
    best = pick_per_keyword(rows, 4, "keyword", F.col("p_retailprice") / 1000, [F.asc("p_partkey")], ["p_brand"])
    return best.select("p_brand", "keyword", "p_partkey", "score")


@query(
    f"""WITH {_KNN},
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM c WHERE n <= 2)
SELECT query_id, count(*) AS returned, count(*) - count(DISTINCT label) AS repeated,
       count(*) FILTER (label > 6) AS violations, count(*) FILTER (label = 9) AS unknown FROM p WHERE pick <= 10 GROUP BY query_id"""
)
def result_observation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = group_cap_topk(spark, sf_dir).withColumns({"violates": F.col("label") > 6, "is_unknown": F.col("label") == 9})
    return observe(items, "query_id", "label")


@query(
    """SELECT count(*) AS n, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim,
  round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS min_norm,
  round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS max_norm,
  bool_and(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS finite FROM embeddings"""
)
def vector_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return s.withColumns({c: F.round(c, 6) for c in ("min_norm", "max_norm")})


# --- preparation


@query("SELECT doc_id, k AS kept_code FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS k FROM documents) WHERE doc_id <> k")
def exact_dedup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat an earlier text, and which; texts are compared by their SHA-256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return cleaning.deduplicate(docs, ["digest"], "doc_id")[1]


@query(
    """WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS k FROM documents), a AS (SELECT doc_id FROM m WHERE doc_id = k), b AS (SELECT doc_id, k FROM m WHERE doc_id <> k)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (doc_id)) AS in_both, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b)) AS lost,
  (SELECT count(*) FROM m ANTI JOIN documents USING (doc_id)) AS added, (SELECT count(DISTINCT k) FROM b WHERE k NOT IN (SELECT doc_id FROM a)) AS dangling"""
)
def dedup_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    kept, moved = cleaning.deduplicate(docs, ["digest"], "doc_id")
    return joins.key_integrity(docs, kept, moved, "doc_id", "kept_code")


@query(
    """WITH k AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text)
SELECT doc_id, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1)::BIGINT AS position FROM k"""
)
def dedup_in_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without copies in the order of the input, here one that has nothing to do with the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("place"))
    kept, _ = ordering.deduplicated_in_order(docs, ["digest"], "doc_id", "place")
    return kept.select("doc_id", "position")


_NAMED = """n AS (SELECT CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN p_name ELSE p_name || ' ' || lower(p_type) END AS name FROM part),
d AS (SELECT name, count(*) AS n FROM n GROUP BY name)"""


@query(
    f"""WITH {_NAMED}, s AS (SELECT b.name, count(*) AS shorter FROM d a JOIN d b ON starts_with(b.name, a.name || ' ') GROUP BY b.name),
l AS (SELECT a.name, count(*) AS longer FROM d a JOIN d b ON starts_with(b.name, a.name || ' ') GROUP BY a.name),
e AS (SELECT replace(name, ' ', '') AS key, count(*) - 1 AS equal FROM d GROUP BY 1)
SELECT d.name, n, coalesce(shorter, 0) AS shorter, coalesce(longer, 0) AS longer, equal FROM d LEFT JOIN s USING (name) LEFT JOIN l USING (name) JOIN e ON key = replace(d.name, ' ', '')"""
)
def name_variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names begin which others, over all parts, by a table of prefixes."""
    first = F.substring_index("p_name", " ", 1)
    longer = F.concat_ws(" ", "p_name", F.lower("p_type"))
    kind = F.col("p_partkey") % 3
    named = table(spark, sf_dir, "part").select(F.when(kind == 0, first).when(kind == 1, F.col("p_name")).otherwise(longer).alias("name"), F.lit("").alias("company"))
    return variants.name_variants(named, "name", "company")


@query("SELECT count(*) AS n_pairs, 0::BIGINT AS repeated, 0::BIGINT AS too_large, true AS few FROM lineitem")
def conflict_free_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders and parts in batches of 16 without a repeated order or part: what breaks the rule, and whether the batches
    are at most half as many again as they must be, and a thousand (of colours that few pairs have)."""
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    made = stored(sampling.conflict_free_batches(pairs, "l_orderkey", "l_partkey", 16), "batches")
    per = made.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("a"), F.countDistinct("l_partkey").alias("b"))
    out = per.agg(F.sum("n").alias("n_pairs"), F.sum(2 * F.col("n") - F.col("a") - F.col("b")).alias("repeated"), F.count_if(F.col("n") > 16).alias("too_large"), F.count("*").alias("batches"))
    degree = lambda c: made.groupBy(c).count().agg(F.max("count").alias(f"{c}_most"))
    out = out.join(degree("l_orderkey")).join(degree("l_partkey"))
    least = F.greatest(F.col("n_pairs") / 16, "l_orderkey_most", "l_partkey_most")
    return out.select("n_pairs", "repeated", "too_large", (F.col("batches") <= 1.5 * least + 1000).alias("few"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS utc, strftime(ts, '%Y%m%dT%H%M%SZ') AS run FROM events")
def event_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's time as text, for logs and for names."""
    return table(spark, sf_dir, "events").select("event_id", utc_stamp(F.col("ts")).alias("utc"), compact_stamp(F.col("ts")).alias("run"))


@query(
    """SELECT substr(sha1(p_name || '|' || p_type), 1, 12) AS unit_id, arg_min(p_brand, p_partkey) AS p_brand, min(p_partkey) AS p_partkey,
  string_agg(p_partkey::VARCHAR, ';' ORDER BY p_partkey::VARCHAR) AS codes, count(*) AS n FROM part GROUP BY p_name, p_type"""
)
def unit_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.record_groups(table(spark, sf_dir, "part"), ["p_name", "p_type"], "p_partkey", ["p_brand"])


_QUOTA = """
c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
w AS (SELECT *, sqrt(n) / sum(sqrt(n)) OVER () * {total} AS raw FROM c),
f AS (SELECT *, least(floor(raw), n)::BIGINT AS fl FROM w),
g AS (SELECT *, {total} - sum(fl) OVER () AS rest, row_number() OVER (PARTITION BY fl < n ORDER BY round(raw - floor(raw), 9) DESC, lang) AS o FROM f),
quota AS (SELECT lang, n, fl + (fl < n AND o <= rest)::BIGINT AS quota FROM g)"""


@query(f"WITH {_QUOTA.format(total=100)} SELECT * FROM quota")
def sqrt_quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sqrt_quotas(profile.value_counts(table(spark, sf_dir, "documents"), "lang"), 100, "lang")


@query(
    f"""WITH {_QUOTA.format(total=60)}, d AS (SELECT *, n_chars > 1000 AS long, md5('42|' || doc_id::VARCHAR) AS h FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY lang, long ORDER BY h, doc_id) AS turn FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY 2 * turn + long::INT, h, doc_id) AS place FROM t)
SELECT doc_id, p.lang, long FROM p JOIN quota USING (lang) WHERE place <= quota"""
)
def stratified_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents by language, short and long ones in turn, in a seeded order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).alias("long"))
    quotas = sampling.sqrt_quotas(profile.value_counts(docs, "lang"), 60, "lang")
    return sampling.stratified_take(docs, quotas, "lang", "doc_id", queue="long").select("doc_id", "lang", "long")


@query(
    """WITH u AS (SELECT *, p_size > 45 AS odd, p_partkey % 2 = 1 AS second, md5('42|' || p_partkey::VARCHAR) AS h FROM part),
able AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY odd DESC, h, p_partkey) AS n FROM u) WHERE n <= 3),
heads AS (SELECT *, row_number() OVER (PARTITION BY second ORDER BY h, p_partkey) AS q FROM able WHERE odd),
ahead AS (SELECT p_partkey FROM heads WHERE q <= 10 ORDER BY 2 * q + second::INT, h, p_partkey LIMIT 10),
rest AS (SELECT * FROM able ANTI JOIN ahead USING (p_partkey)), k AS (SELECT 100 - count(*) AS total FROM ahead),
c AS (SELECT p_type, count(*) AS m FROM rest GROUP BY p_type), w AS (SELECT *, sqrt(m) / sum(sqrt(m)) OVER () * total AS raw FROM c, k),
f AS (SELECT *, least(floor(raw), m)::BIGINT AS fl FROM w),
g AS (SELECT *, total - sum(fl) OVER () AS lack, row_number() OVER (PARTITION BY fl < m ORDER BY round(raw - floor(raw), 9) DESC, p_type) AS o FROM f),
quota AS (SELECT p_type, fl + (fl < m AND o <= lack)::BIGINT AS quota FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY p_type, second ORDER BY h, p_partkey) AS turn FROM rest),
p AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY 2 * turn + second::INT, h, p_partkey) AS place FROM t),
shared AS (SELECT p_partkey, p.p_type, p_name, h FROM p JOIN quota USING (p_type) WHERE place <= quota),
left_over AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) AS nth FROM rest ANTI JOIN shared USING (p_partkey))
SELECT p_partkey, p_type, p_name, 'first' AS why FROM able SEMI JOIN ahead USING (p_partkey) UNION ALL SELECT p_partkey, p_type, p_name, 'quota' FROM shared
UNION ALL SELECT p_partkey, p_type, p_name, 'fill' FROM left_over WHERE nth <= (SELECT total FROM k) - (SELECT count(*) FROM shared)"""
)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced sample of 100 parts: unusual ones first, quotas by type, at most three of a name."""
    parts = table(spark, sf_dir, "part").withColumns({"odd": F.col("p_size") > 45, "second": F.pmod("p_partkey", F.lit(2)) == 1})
    return sampling.sample_units(parts, 100, 10, 3, "p_type", "p_name", "odd", "second", "p_partkey").select("p_partkey", "p_type", "p_name", "why")


@query(
    """SELECT p_partkey,
  CASE WHEN p_type IN ('SMALL', 'MEDIUM') AND contains(p_name, 'ring') THEN 'side' WHEN p_type = 'PROMO' AND p_size > 25 THEN 'meal'
       WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'dessert' WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'meal' ELSE 'other' END AS grp,
  CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'metal' WHEN regexp_matches(p_name, 'hot|red$') THEN 'warm' ELSE 'plain' END AS kind,
  regexp_matches(p_name, 'widget') OR (regexp_matches(p_name, 'ring|rod') AND NOT regexp_matches(p_name, 'hot|old')) AS side FROM part"""
)
def category_case_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-rung, first-match and keyword classes."""
    kind, name, size = F.col("p_type"), F.col("p_name"), F.col("p_size")
    rungs = (
        (kind.isin("SMALL", "MEDIUM", "LARGE"), "meal"),
        (kind.isin("PROMO", "ECONOMY"), "dessert"),
        ((kind == "PROMO") & (size > 25), "meal"),
        (kind.isin("SMALL", "MEDIUM") & F.contains(name, F.lit("ring")), "side"),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        cleaning.ladder(*rungs, default="other").alias("grp"),
        cleaning.first_match(name, [("metal", "bolt|gear"), ("warm", "hot|red$")], "plain").alias("kind"),
        cleaning.keyword_class(name, ["widget"], ["ring", "rod"], ["hot", "old"]).alias("side"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN (p_size + 0.5)::DOUBLE END AS value,
  CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' END AS unit FROM part"""
)
def parse_quantity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 3 == 0, "g").when(F.col("p_partkey") % 3 == 1, " ML ").otherwise("인분")
    q = parse_quantity(F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit))
    return table(spark, sf_dir, "part").select("p_partkey", q["value"].alias("value"), q["unit"].alias("unit"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || ' ' || p_name END AS menu, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS prefix,
  CASE WHEN p_partkey % 3 = 0 THEN 'ICED' END AS temperature, CASE WHEN p_partkey % 5 = 0 THEN 'L' END AS size FROM part"""
)
def parse_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, temperature, size and menu of raw names."""
    key = F.col("p_partkey")
    raw = F.concat("p_type", F.lit("_"), "p_name", F.when(key % 3 == 0, " 아이스 (ICED)").otherwise(""), F.when(key % 5 == 0, "(L)").otherwise(" "))
    return table(spark, sf_dir, "part").select("p_partkey", parse_name(raw, key % 2 == 0).alias("n")).select("p_partkey", "n.*")


@query(
    """SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, o_orderpriority IS DISTINCT FROM '4-NOT SPECIFIED' AS given FROM orders"""
)
def sentinel_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", cleaning.names_company(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("given"))
    return cleaning.sentinel_to_null(rows, ["o_orderpriority"], "4-NOT SPECIFIED")


@query(
    """SELECT p_partkey, concat_ws(' ', p_name, p_type) AS text_a,
  concat_ws(' ', p_name, p_type, CASE WHEN p_size < 10 THEN '매운맛 없음' WHEN p_size < 30 THEN '매운맛 강함' END, CASE WHEN p_size % 2 = 0 THEN '국물없음' END) AS text_b FROM part"""
)
def embedding_text_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text variants; unknown labels and repeated parts are left out."""
    size = F.col("p_size")
    labels = F.create_map(
        F.lit("매운맛"), F.when(size < 10, "없음").when(size < 30, "강함").otherwise(UNKNOWN), F.lit("국물"), F.when(size % 2 == 0, "국물없음").otherwise(F.lit(None).cast("string"))
    )
    parts = (F.col("p_name"), F.col("p_name"), F.col("p_type"), labels)
    return table(spark, sf_dir, "part").select("p_partkey", embedding_text("A", *parts).alias("text_a"), embedding_text("B", *parts).alias("text_b"))


@query(
    """SELECT c_custkey, c_name LIKE '%00' AS chain, CASE WHEN c_name LIKE '%00' THEN '' ELSE c_name END AS company FROM customer"""
)
def company_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_name").endswith("00"), F.lit("-")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", (company(raw) == "").alias("chain"), company(raw).alias("company"))


# --- joins


@query(
    """WITH l AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS r FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1), b AS (SELECT * FROM l FULL JOIN r USING (k))
SELECT sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right, count(*) FILTER (l > 1) AS dup_left, count(*) FILTER (r > 1) AS dup_right,
  count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS joined, count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only,
  count(*) FILTER (l > 1 OR r > 1 OR l IS NULL OR r IS NULL) = 0 AS is_clean FROM b"""
)
def inner_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    right = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    return joins.join_audit(left, right, "k")


@query(
    """WITH u AS (SELECT user_id, max_by(event_id, event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id),
l AS (SELECT user_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, event_id, value FROM u JOIN l USING (user_id)"""
)
def last_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs joined by user; of repeated users the last row of each log counts."""
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'view'").select("user_id", "event_id", F.col("event_id").alias("seq"))
    right = events.filter("event_type = 'purchase'").select("user_id", "value", F.col("event_id").alias("seq"))
    return joins.join_by_id(left, right, "user_id", "seq")


@query(
    """WITH c AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS pos FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT l_orderkey, coalesce(string_agg(p_name, ',' ORDER BY pos), '') AS found, coalesce(string_agg(CASE WHEN p_partkey IS NULL THEN l_partkey::VARCHAR END, ',' ORDER BY pos), '') AS missing
FROM c LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey GROUP BY l_orderkey"""
)
def explode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part names of each order's list of parts, and the parts that the lookup table lacks."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("codes"))
    parts = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("code"), "p_name")
    out = joins.explode_lookup(lists, "l_orderkey", F.col("codes"), parts, "code", "p_name")
    return out.select("l_orderkey", F.array_join("found", ",").alias("found"), F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query(
    """SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'short' WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS kind,
  CASE WHEN l.doc_id IS NULL THEN 'rule' ELSE 'given' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    given = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "short").otherwise("other").alias("kind"))
    rule = F.when(F.col("n_chars") > 1000, "long").otherwise("short")
    return joins.override(docs, given, "doc_id", "kind", rule, ["short", "long"]).select("doc_id", "kind", "source")


@query(
    """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'corrected' WHEN doc_id % 3 = 0 THEN 'approved' END AS rv, (doc_id % (CASE WHEN doc_id % 10 = 0 THEN 7 ELSE 5 END))::VARCHAR AS ck,
  CASE WHEN doc_id % 4 = 0 THEN 'v' END AS v FROM labels WHERE doc_id % 2 = 0), h AS (SELECT * FROM e WHERE rv IS NOT NULL OR v IS NOT NULL)
SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'success' END AS status, (l.doc_id % 7)::VARCHAR AS cache_key,
  CASE WHEN h.doc_id IS NULL OR toxic = 1 THEN 'pending' WHEN ck = (l.doc_id % 7)::VARCHAR THEN rv ELSE 'recheck' END AS review, h.v AS value
FROM labels l LEFT JOIN h USING (doc_id)"""
)
def upsert_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new sheet with the reviewer's earlier values; two versions of some earlier rows."""
    rows = table(spark, sf_dir, "labels")
    key = F.col("doc_id")
    sheet = rows.select(
        "doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("success").alias("status"), (key % 7).cast("string").alias("cache_key"), F.lit("pending").alias("review"), F.lit(None).cast("string").alias("value")
    )
    value = F.when(key % 4 == 0, "v").alias("value")
    earlier = rows.filter("doc_id % 2 = 0")
    first = earlier.select("doc_id", F.when(key % 3 == 0, "approved").alias("review"), (key % 5).cast("string").alias("cache_key"), value, F.lit(1).alias("seq"))
    second = earlier.filter("doc_id % 10 = 0").select("doc_id", F.lit("corrected").alias("review"), (key % 7).cast("string").alias("cache_key"), value, F.lit(2).alias("seq"))
    return joins.upsert_review(sheet, first.unionByName(second), "doc_id", ["value"], ["approved", "corrected"], "seq")


@query(
    """SELECT (doc_id % 5)::VARCHAR AS query, doc_id::VARCHAR AS id, CASE WHEN quality = 1 THEN '2' ELSE '' END AS grade, CASE WHEN quality = 1 THEN 'approved' ELSE 'unjudged' END AS review FROM labels"""
)
def pool_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).cast("string").alias("query"), F.col("doc_id").cast("string").alias("id"), "quality")
    existing = rows.filter("quality = 1").select("query", "id", F.lit("2").alias("grade"), F.lit("approved").alias("review"))
    pool = rows.select("query", "id")
    return joins.merge_pool(existing, pool.unionByName(pool), ["query", "id"], {"review": "unjudged"})


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_per_key(table(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


# --- evaluation


#: Neighbours of a query that are judged, but for a third of them.
POOL = 20


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of each query: its nearest vectors with both labels."""
    vectors = table(spark, sf_dir, "embeddings")
    found = _neighbours(spark, sf_dir, POOL).join(vectors.select("vec_id", "label"), "vec_id")
    named = vectors.filter(ASKED).select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    return found.join(named, "query_id").select(F.col("query_id").alias("query"), F.col("vec_id").alias("id"), "rank", "label", "q_label")


def _grades(found: DataFrame) -> DataFrame:
    """Judgments of two thirds of the pool, by how far the labels are apart."""
    gap = F.abs(F.col("label") - F.col("q_label"))
    judged = found.filter((F.col("id") + F.col("query")) % 3 != 0)
    return judged.select("query", "id", F.when(gap == 0, 2).when(gap == 1, 1).otherwise(0).alias("grade"))


_GRADED = """
j AS (SELECT query_id, vec_id, CASE abs(label - q_label) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS grade FROM r WHERE rank <= 20 AND (query_id + vec_id) % 3 <> 0),
i AS (SELECT query_id, sum((2.0::DOUBLE ** grade - 1) / log2(p + 1.0)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, vec_id) AS p FROM j) WHERE p <= 5 GROUP BY query_id)"""
_METRICS = f"""WITH {_KNN}, {_GRADED},
t AS (SELECT r.query_id, r.rank, j.grade, coalesce(j.grade, 0) AS g FROM r LEFT JOIN j USING (query_id, vec_id) WHERE rank <= 5),
m AS (SELECT query_id AS query, count(*) AS returned, count(*) FILTER (grade IS NULL) AS unjudged, count(*) FILTER (g >= 2) / 5.0::DOUBLE AS precision,
  sum((2.0::DOUBLE ** g - 1) / log2(rank + 1.0)) AS dcg, coalesce(max(CASE WHEN g >= 2 THEN 1.0::DOUBLE / rank END), 0) AS rr, count(*) FILTER (g >= 2) AS n_relevant, count(*) FILTER (g = 1) AS n_partial FROM t GROUP BY query_id),
e AS (SELECT m.*, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg FROM m LEFT JOIN i ON query = query_id)"""


@query(f"{_METRICS} SELECT query, returned, unjudged, precision, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr, n_relevant, n_partial FROM e")
def ndcg_precision_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    out = evaluation.per_query(found, _grades(found), 5)
    return out.withColumns({c: F.round(c, 6) for c in ("ndcg", "rr")})


@query(
    f"{_METRICS} SELECT count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, round(sum(unjudged) / greatest(sum(returned), 1)::DOUBLE, 6) AS unjudged FROM e"
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    out = evaluation.summary(evaluation.per_query(found, _grades(found), 5))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "ndcg", "mrr", "unjudged")})


@query(
    f"""WITH {_KNN}, {_GRADED},
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM (SELECT r.query_id, r.rank, j.grade FROM r JOIN j USING (query_id, vec_id) WHERE rank <= 20)),
d AS (SELECT query_id, sum((2.0::DOUBLE ** grade - 1) / log2(p + 1.0)) AS dcg FROM c WHERE p <= 5 GROUP BY query_id),
b AS (SELECT query_id, count(*) AS n FROM j WHERE grade = 2 GROUP BY query_id),
h AS (SELECT r.query_id, count(*) AS hits FROM r JOIN j USING (query_id, vec_id) WHERE rank <= 10 AND j.grade = 2 GROUP BY r.query_id)
SELECT q.query_id AS query, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg, round(CASE WHEN n > 0 THEN coalesce(hits, 0) / least(10, n)::DOUBLE END, 6) AS recall
FROM (SELECT DISTINCT query_id FROM r) q LEFT JOIN d USING (query_id) LEFT JOIN i USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN h USING (query_id)"""
)
def condensed_ndcg_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    out = evaluation.condensed(found, _grades(found), found)
    return out.withColumns({c: F.round(c, 6) for c in ("ndcg", "recall")})


def drawn(table: str, iterations: int, seed: int) -> str:
    """SQL for the means ``m`` of every iteration over ``table`` (query_id, diff), weighed by the numbers of Poisson draws."""
    weight = " + ".join(f"(h >= {t})::INT" for t in evaluation.poisson_thresholds())
    return f"""w AS (SELECT k, diff, {weight} AS c FROM (SELECT k.range AS k, diff, ('0x' || substr(md5('{seed}|' || k.range || '|' || query_id), 1, 8))::BIGINT AS h FROM range({iterations}) k, {table})),
m AS (SELECT k, CASE WHEN sum(c) > 0 THEN sum(c * diff)::DOUBLE / sum(c) ELSE (SELECT sum(diff)::DOUBLE / count(*) FROM {table}) END AS m FROM w GROUP BY k)"""


@query(
    f"""WITH {_KNN}, x AS (SELECT query_id, (max(sim) FILTER (rank = 1) - max(sim) FILTER (rank = 5) - 0.05)::DECIMAL(20, 9) AS diff FROM r GROUP BY query_id),
{drawn("x", 2000, 0)}, o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m),
e AS (SELECT max(m) FILTER (r = 50) AS low, max(m) FILTER (r = 1949) AS high FROM o)
SELECT (SELECT sum(diff)::DOUBLE / count(*) FROM x) AS mean_diff, (SELECT count(*) FROM x) AS n, low, high, low <= 0 AND high >= 0 AS holds_zero FROM e"""
)
def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of a mean difference by 2,000 resamples of all queries."""
    found = _neighbours(spark, sf_dir, 5)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("sim")))
    diffs = found.groupBy(F.col("query_id").alias("query")).agg((at(1) - at(5) - 0.05).alias("diff"))
    return evaluation.paired_bootstrap(diffs, 2000, 0)


@query(
    """WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels GROUP BY 1, 2), x AS (SELECT x, sum(n) AS rx FROM c GROUP BY x), y AS (SELECT y, sum(n) AS cy FROM c GROUP BY y),
t AS (SELECT sum(n) AS n, sum(CASE WHEN x = y THEN n ELSE 0 END) AS agreed, sum((x - y) ** 2 * n) AS off FROM c), e AS (SELECT sum(CASE WHEN x = y THEN rx * cy ELSE 0 END) AS agree, sum((x - y) ** 2 * rx * cy) AS apart FROM x, y)
SELECT n::BIGINT AS n, agreed::BIGINT AS agreed, round((agreed / n::DOUBLE - agree / (n::DOUBLE * n)) / (1 - agree / (n::DOUBLE * n)), 6) AS kappa, round(1 - off * n / apart, 6) AS kappa_quadratic FROM t, e"""
)
def confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.kappa(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])
    return out.withColumns({c: F.round(c, 6) for c in ("kappa", "kappa_quadratic")})


@query("""SELECT doc_id, list_sum(list_transform(regexp_extract_all(md5(doc_id::VARCHAR), '.'), lambda c: ('0x' || c)::INT)) % 3 = 0 AS is_test FROM documents""")
def md5_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", is_test_query(F.col("doc_id").cast("string")).alias("is_test"))


# --- profiles


@query(
    """SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS row, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS col, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "O",
  round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS "P" FROM orders GROUP BY 1"""
)
def pivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pivot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.round(F.avg("o_totalprice"), 4))


_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, round(1 - count({c}) / count(*)::DOUBLE, 6) AS missing FROM orders"
        for c in _PROFILED
    )
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(table(spark, sf_dir, "orders"), _PROFILED)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS low, round(median({c}), 4)::DOUBLE AS middle, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean FROM lineitem"
        for c in ("l_quantity", "l_discount")
    )
)
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.numeric_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return out.withColumns({c: F.round(c, 4) for c in ("middle", "mean")})


@query(
    """SELECT count(*) AS n_keys, count(*) FILTER (v > 1) AS n_broken, count(*) FILTER (v > 1) = 0 AS holds FROM (SELECT p_name, count(DISTINCT p_type) AS v FROM part GROUP BY p_name)"""
)
def functional_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.functional_dependency(table(spark, sf_dir, "part"), "p_name", "p_type")


@query(
    """SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(n - 1)::BIGINT AS n_extra, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_in_groups
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
)
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.duplicate_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT p_type, count(*) FILTER (p_size > 10) AS before, count(*) FILTER (p_size > 30) AS after, count(*) FILTER (p_size > 10 AND p_size <= 30) AS converted FROM part GROUP BY ROLLUP (p_type)"""
)
def conversion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.converted(table(spark, sf_dir, "part"), "p_type", F.col("p_size") > 10, F.col("p_size") > 30)


# --- feedback


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), "turn", F.coalesce("text", F.lit("")).alias("query"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, choices and errors as feedback on the turns of the conversation with the user's number, one turn an event."""
    many = _turns(spark, sf_dir).groupBy("user_id").agg((F.max("turn") + 1).alias("turns"))
    events = table(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase', 'error')").join(many, "user_id").withColumn("turn", F.col("event_id") % F.col("turns"))
    keyword = F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))
    liked = F.when(F.col("event_type") == "click", 1).otherwise(0)
    return events.select("event_id", "user_id", "turn", keyword.alias("keyword"), liked.alias("liked"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("chosen"))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes with the texts of their turns."""
    return _votes(spark, sf_dir).join(_turns(spark, sf_dir), ["user_id", "turn"]).select("event_id", "query", "keyword", "liked", "chosen")


_FEEDBACK = """
n AS (SELECT conv_id, max(turn) + 1 AS turns FROM conversations GROUP BY conv_id),
f AS (SELECT event_id, coalesce(text, '') AS query, 'k' || (event_id % 7)::VARCHAR AS keyword, (event_type IN ('click', 'purchase'))::INT AS liked, (event_type = 'purchase')::INT AS chosen
      FROM events JOIN n ON user_id = n.conv_id JOIN conversations c ON c.conv_id = n.conv_id AND turn = event_id % turns WHERE event_type IN ('click', 'purchase', 'error')),
x AS (SELECT query, keyword, liked, chosen, unnest(list_distinct(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''))) AS token FROM f),
c AS (SELECT token, keyword, sum(CASE WHEN liked = 1 THEN 1 + chosen ELSE 0 END)::BIGINT AS likes, sum(CASE WHEN liked = 0 THEN 1 ELSE 0 END)::BIGINT AS dislikes FROM x GROUP BY token, keyword)"""


@query(f"WITH {_FEEDBACK} SELECT * FROM c")
def token_feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.token_counts_by_text(_votes(spark, sf_dir), _turns(spark, sf_dir), ["user_id", "turn"])


@query(f"WITH {_FEEDBACK} SELECT * FROM c")
def feedback_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters kept by a Structured Streaming query over a folder to which events are added: three batches, of which
    each rewrites the buckets that it touches."""
    source, counts, checkpoint = (shared_path(spark, f"feedback-{part}") for part in ("events", "counts", "checkpoint"))
    events = stored(_feedback(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("query", "keyword"), F.lit(3))), "feedback")
    for part in range(3):
        events.filter(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        found, _ = feedback.run_stream(spark, source, events.drop("part").schema, counts, checkpoint)
    return found


@query(
    f"""WITH {_FEEDBACK}, q AS (SELECT DISTINCT query, 'k' || ((length(query) + 1) % 7)::VARCHAR AS keyword FROM f),
t AS (SELECT query, keyword, unnest(list_distinct(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''))) AS token FROM q)
SELECT query, keyword, (15 * sum(coalesce((likes - dislikes) * 1000000000 // (likes + dislikes + 2), 0)))::DOUBLE / (count(*) * 100000000000)::DOUBLE AS boost
FROM t LEFT JOIN c USING (token, keyword) GROUP BY query, keyword"""
)
def feedback_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _votes(spark, sf_dir).select("user_id", "turn").distinct().join(_turns(spark, sf_dir), ["user_id", "turn"])  # each once, however many events
    pairs = texts.select("query", F.concat(F.lit("k"), ((F.length("query") + 1) % 7).cast("string")).alias("keyword"))
    counts = feedback.token_counts_by_text(_votes(spark, sf_dir), _turns(spark, sf_dir), ["user_id", "turn"])
    return feedback.boosts(pairs, counts)


@query(f"WITH {_FEEDBACK} SELECT query, keyword FROM f GROUP BY query, keyword HAVING sum(liked) * 2 > count(*)")
def liked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.liked_pairs(_feedback(spark, sf_dir))


# --- label quality


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    code = F.when(key % 7 == 0, F.lit("x")).otherwise(key.cast("string"))
    body = F.concat(F.lit('```json\n{"code": "'), code, F.lit('", "labels": {"k": "'), k, F.lit('", "z": "1"}, "reason": "'), F.when(key % 13 == 0, " ").otherwise("r"), F.lit('"}\n```'))
    return table(spark, sf_dir, "events").select("event_id", F.when(key % 11 == 0, F.lit("{broken")).otherwise(body).alias("text"), F.lit(None).cast("string").alias("temperature"))


@query(
    """WITH t AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not JSON' WHEN event_id % 7 = 0 THEN 'other code' WHEN k::INT > 100 THEN 'not allowed: k=' || k WHEN event_id % 13 = 0 THEN 'blank reason' END AS error,
  CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR k::INT > 100 OR event_id % 13 = 0 THEN NULL ELSE k END AS k,
  CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR k::INT > 100 OR event_id % 13 = 0 THEN NULL ELSE 'extra attributes' END AS flags FROM t"""
)
def json_validate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labelqc.validate_responses(_responses(spark, sf_dir), "text", "event_id", "temperature", {"k": [str(i) for i in range(101)]})
    return out.select("event_id", "error", F.col("labels")["k"].alias("k"), F.array_join("flags", ";").alias("flags"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", "validation_failed").when(F.col("event_type") == "signup", "transient_failed").otherwise("success")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", status.alias("status"), F.when(F.col("event_id") % 9 == 0, "mock").otherwise("live").alias("mode"), F.when(k > 75, F.array(F.lit("temperature conflict"))).alias("flags"),
        F.col("user_id").cast("string").alias("cache_key"), F.when(F.col("event_type") == "error", "bad").alias("error"), F.length("props").cast("long").alias("input_tokens"), k.cast("long").alias("output_tokens"),
    )


_ATTEMPTS = """
a AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'validation_failed' WHEN 'signup' THEN 'transient_failed' ELSE 'success' END AS status, CASE WHEN event_id % 9 = 0 THEN 'mock' ELSE 'live' END AS mode,
  json_extract_string(props, '$.k')::INT AS k, length(props) AS input_tokens FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM a WHERE mode = 'live') WHERE n = 1)"""


@query(
    f"""WITH {_ATTEMPTS}, t AS (SELECT count(DISTINCT user_id) AS attempted, count(DISTINCT CASE WHEN status = 'validation_failed' THEN user_id END) AS bad FROM a WHERE mode = 'live'),
s AS (SELECT count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'success' AND k > 75) AS conflicts FROM l)
SELECT attempted, successes, round(bad / attempted::DOUBLE, 4) AS format_error_rate, round(conflicts / nullif(successes, 0)::DOUBLE, 4) AS conflict_rate FROM t, s"""
)
def attempt_log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelqc.attempt_quality(_attempts(spark, sf_dir), "user_id", "event_id")


@query(
    f"""WITH {_ATTEMPTS}, b AS (SELECT 'all' AS scope, * FROM a UNION ALL SELECT 'run', * FROM a WHERE event_id % 2 = 0)
SELECT scope, status, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(k)::BIGINT AS output_tokens, round(sum(input_tokens * 3.0::DOUBLE + k * 15.0::DOUBLE) / 1e6 * 0.5, 6) AS cost FROM b GROUP BY scope, status"""
)
def run_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _attempts(spark, sf_dir).withColumn("cost", labelqc.estimated_cost(F.col("input_tokens"), F.col("output_tokens"), (3.0, 15.0), batch=True))
    return labelqc.run_summary(log, F.col("event_id") % 2 == 0).withColumn("cost", F.round("cost", 6))


_CALLS = """
w AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS until FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ms, seq) AS n FROM (
  SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS unit, epoch_us(ts) // 1000 AS ms, event_id AS seq, json_extract_string(props, '$.k')::DOUBLE AS cost,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'transient_failed' WHEN 'view' THEN 'permanent_failed' ELSE 'validation_failed' END AS outcome
  FROM events, w WHERE epoch_us(ts) // 1000 <= until)),
r AS (SELECT DISTINCT unit, 0::BIGINT AS n, '' AS status, 0 AS attempt, 0 AS invalid, 0::BIGINT AS waited, 0.0::DOUBLE AS spent, 0::BIGINT AS ms, 0::BIGINT AS seq, false AS done,
    false AS idle, '' AS o_status, 0 AS o_attempt, 0 AS o_invalid, 0::BIGINT AS o_waited, 0.0::DOUBLE AS o_spent, 0::BIGINT AS o_ms, 0::BIGINT AS o_seq, false AS ends FROM e
  UNION ALL
  SELECT unit, n, CASE WHEN stop THEN 'stopped' ELSE outcome END, CASE WHEN stop THEN b_attempt ELSE b_attempt + 1 END, CASE WHEN stop THEN b_invalid ELSE b_invalid + (outcome = 'validation_failed')::INT END,
    CASE WHEN stop OR outcome <> 'transient_failed' THEN b_waited ELSE b_waited + 2 * (b_attempt + 1) END, CASE WHEN stop OR outcome = 'transient_failed' THEN o_spent ELSE o_spent + cost END, e_ms, e_seq, stop OR outcome = 'success',
    idle, o_status, o_attempt, o_invalid, o_waited, o_spent, o_ms, o_seq, stop OR outcome IN ('success', 'permanent_failed') OR b_attempt + 1 > 2
  FROM (SELECT unit, n, outcome, cost, e_ms, e_seq, idle, status AS o_status, attempt AS o_attempt, invalid AS o_invalid, waited AS o_waited, spent AS o_spent, ms AS o_ms, seq AS o_seq, spent + 100 > 250 AS stop,
      CASE WHEN idle THEN 0 ELSE attempt END AS b_attempt, CASE WHEN idle THEN 0 ELSE invalid END AS b_invalid, CASE WHEN idle THEN 0 ELSE waited END AS b_waited
    FROM (SELECT r.unit, e.n, e.outcome, e.cost, e.ms AS e_ms, e.seq AS e_seq, r.status, r.spent, r.ms, r.seq, CASE WHEN ends THEN 0 ELSE attempt END AS attempt, CASE WHEN ends THEN 0 ELSE invalid END AS invalid,
        CASE WHEN ends THEN 0 ELSE waited END AS waited, NOT ends AND attempt > 0 AND e.ms - r.ms > 21600000 AS idle
      FROM r JOIN e ON e.unit = r.unit AND e.n = r.n + 1 WHERE NOT done))),
z AS (SELECT *, lead(n) OVER (PARTITION BY unit ORDER BY n) IS NULL AS last FROM r)"""


@query(
    f"""WITH RECURSIVE {_CALLS}
SELECT unit, o_status AS status, o_attempt AS attempt, o_invalid AS invalid, o_waited AS waited, o_spent AS spent, o_ms AS ms, o_seq AS seq FROM z WHERE idle
UNION ALL SELECT unit, status, attempt, invalid, waited, spent, ms, seq FROM z WHERE ends
UNION ALL SELECT unit, status, attempt, invalid, waited, spent, ms, seq FROM z, w WHERE last AND NOT ends AND attempt > 0 AND ms + 21600000 <= until"""
)
def attempt_final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of every call, from a stream of attempts with keyed state: retries, backoff, budget and idle calls."""
    source, log, checkpoint = (shared_path(spark, f"attempts-{part}") for part in ("source", "log", "checkpoint"))
    outcome = F.when(F.col("event_type") == "purchase", attempts.SUCCESS).when(F.col("event_type") == "signup", attempts.TRANSIENT).when(F.col("event_type") == "view", attempts.PERMANENT).otherwise(attempts.INVALID)
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("unit"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), outcome.alias("outcome"),
        F.get_json_object("props", "$.k").cast("double").alias("cost"),
    )
    rows.coalesce(100).write.parquet(source)  # files of one micro-batch: what a later one brings may lie behind the watermark
    policy = attempts.Policy(retries=2, wait=2, budget=250.0, ceiling=100.0, idle=21_600_000)
    found = attempts.run_attempts(spark, source, rows.schema, log, checkpoint, policy)
    return found.filter("final").drop("final")


@query(
    """SELECT 1 AS version, count(*) AS n, sum(quality)::BIGINT AS good FROM labels
UNION ALL SELECT 2, count(*), sum(quality)::BIGINT FROM labels WHERE toxic = 0"""
)
def snapshot_swap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of version 1 sees while version 2 is swapped in and version 1 is asked to be removed, and what the next
    reader sees."""
    labels = table(spark, sf_dir, "labels")
    versions = SnapshotTable(spark, shared_path(spark, "snapshots"))
    first = versions.open(versions.write(labels))
    second = versions.open(versions.write(labels.filter("toxic = 0"), expected=first.version))
    versions.expire()  # version 1 is being read and stays
    seen = [r.df.agg(F.lit(r.version).alias("version"), F.count("*").alias("n"), F.sum("quality").cast("long").alias("good")) for r in (first, second)]
    return seen[0].unionByName(seen[1])


@query(
    f"""WITH {_ATTEMPTS}, o AS (SELECT event_id, user_id, coalesce(sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100 > 1000 AS over FROM a)
SELECT event_id, NOT bool_or(over) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS runs FROM o"""
)
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attempts of each user run within a budget."""
    log = _attempts(spark, sf_dir).select("event_id", "user_id", F.col("output_tokens").cast("double").alias("cost"), F.lit(100.0).alias("max_cost"))
    return labelqc.within_budget(log, 1000.0, [F.asc("event_id")], by=["user_id"]).select("event_id", "runs")


@query(
    f"""WITH {_ATTEMPTS} SELECT c_custkey, coalesce(l.status, 'not_run') AS status, CASE WHEN l.status IS NULL THEN 'not_run' WHEN l.status = 'success' THEN 'pending' ELSE 'failed' END AS review,
  CASE WHEN l.status = 'validation_failed' THEN 'bad' END AS error FROM customer LEFT JOIN l ON c_custkey = user_id"""
)
def review_sheet_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = table(spark, sf_dir, "customer").select("c_custkey")
    log = _attempts(spark, sf_dir).withColumnRenamed("user_id", "c_custkey")
    return labelqc.review_sheet(sample, log, "c_custkey", "event_id").select("c_custkey", "status", "review", "error")


@query(
    """WITH r AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 4 <> 0)
SELECT 'missing' AS kind, key FROM e ANTI JOIN r USING (key) UNION ALL SELECT 'duplicate', key FROM r WHERE n > 1 UNION ALL SELECT 'unexpected', key FROM r ANTI JOIN e USING (key)"""
)
def result_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    expected = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return labelqc.result_set_check(results, expected, "k")


@query(
    """SELECT a AS attribute, round(avg((CASE WHEN r IS NULL OR r = m THEN 1 ELSE 0 END)), 4) AS rate, count(*) AS n FROM (
  SELECT 'a' AS a, quality AS m, CASE WHEN doc_id % 2 = 0 THEN toxic END AS r FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT 'b', toxic, CASE WHEN doc_id % 5 = 0 THEN quality END FROM labels WHERE doc_id % 3 <> 0) GROUP BY a"""
)
def reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    sheet = table(spark, sf_dir, "labels").select(
        F.when(key % 3 == 0, "pending").when(key % 3 == 1, "approved").otherwise("corrected").alias("review"),
        F.col("quality").alias("model_a"), F.when(key % 2 == 0, F.col("toxic")).alias("review_a"), F.col("toxic").alias("model_b"), F.when(key % 5 == 0, F.col("quality")).alias("review_b"),
    )
    return labelqc.reviewer_agreement(sheet, ["a", "b"])


# --- query texts

SENTENCES = (
    "맵지 않고 따뜻한 국물", "안 매운 건 싫어", "꼭 매운 거 먹고 싶어", "매운 거 싫어", "피자 말고 치킨", "비 오는 날 얼큰한 국물", "시원하고 얼큰한 거",
    "맵지 않은데 아주 매운", "살짝 매운 떡볶이", "밥 먹고 싶어", "튀김 말고 담백한 한식", "매운 것도 괜찮아", "추운 날 든든한 찌개", "술안주로 바삭한 튀김", "", "오늘 점심 추천",
)


def _asked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, whole, and after it what someone might want to eat."""
    wants = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(SENTENCES))) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", wants).alias("asked"))


@query()
def query_parse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every text, parsed in Arrow batches."""
    return _asked_texts(spark, sf_dir).select("conv_id", "turn", parse_column(F.col("asked")).alias("p")).select("conv_id", "turn", "p.*")


# The tags of each of the sentences (by number), as a person reads them.
_TAGS = (
    (0, "맵지 않고", "맛", True), (0, "국물", "맛", False), (0, "따뜻한", "맛", False), (1, "안 매운 건 싫", "맛", False), (2, "매운", "맛", True), (3, "매운 거 싫어", "맛", True),
    (4, "피자 말고", "메뉴", True), (4, "치킨", "메뉴", False), (5, "얼큰한", "맛", False), (5, "국물", "맛", False), (5, "비 오는 날", "상황", False), (6, "얼큰한", "맛", False),
    (6, "얼큰한, 시원하고", "맛", False), (7, "맵지 않은", "맛", True), (8, "살짝 매운", "맛", False), (8, "떡볶이", "메뉴", False), (9, "밥", "맛", False), (10, "튀김 말고", "맛", True),
    (10, "담백한", "맛", False), (10, "한식", "맛", False), (11, "매운 것도 괜찮", "맛", False), (12, "찌개", "맛", False), (12, "든든한", "맛", False), (12, "추운 날", "상황", False),
    (13, "바삭한, 튀김", "맛", False), (13, "안주", "맛", False), (15, "점심", "상황", False),
)
#: Which sentence each turn asks.  The conversations' own words are in other scripts and no condition.
ASKED_NUMBER = f"(conv_id + turn) % {len(SENTENCES)}"


@query(
    f"""WITH s(i, label, grp, avoid) AS (VALUES {", ".join(f"({i}, '{label}', '{group}', {str(avoid).lower()})" for i, label, group, avoid in _TAGS)})
SELECT conv_id, turn, label, grp, avoid FROM conversations JOIN s ON i = {ASKED_NUMBER}"""
)
def query_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every text, by the table function."""
    register_tags(spark)
    return spark.sql("SELECT conv_id, turn, label, grp, avoid FROM {asked}, LATERAL query_tags(asked)", asked=_asked_texts(spark, sf_dir))


def identity_index(spark: SparkSession, names: list[tuple[str, str, str, dict]]) -> DataFrame:
    """Records whose vectors are the unit axes: component i of a query's vector is its similarity to record i."""
    n = len(names)
    rows = [(f"u{i}", name, rep, cat, "", labels, list(labels.values()), "approved", "model", [float(i == j) for j in range(n)]) for i, (name, rep, cat, labels) in enumerate(names)]
    return spark.createDataFrame(rows, RECORD)


# Dishes and their categories, for vectors to stand for.
DISHES = (("김치 찌개", "찌개 및 전골류"), ("냉면", "면 및 만두류"), ("칼국수", "면 및 만두류"), ("볶음밥", "밥류"), ("치킨", "튀김류"), ("피자", "빵 및 과자류"), ("된장 찌개", "찌개 및 전골류"), ("샐러드", "생채·무침류"))


def vector_records(vectors: DataFrame) -> DataFrame:
    """``vectors`` as records: a dish by the label, every attribute by the id."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    labels = {a: pick([*values, UNKNOWN], F.floor(F.col("vec_id") / (i + 1))) for i, (a, values) in enumerate(DOMAINS.items())}
    labels |= {"계열": pick(["한식", "중식", "양식"], F.col("vec_id")), "안주": pick(["예", "아니오"], F.col("vec_id"))}
    dish = pick([d for d, _ in DISHES], F.col("label"))
    texts = {
        "id": F.format_string("%012d", "vec_id"), "name": F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" "), dish), "representative": dish,
        "category": pick([c for _, c in DISHES], F.col("label")), "company": F.lit(""),
    }
    made = F.create_map(*(x for a, v in labels.items() for x in (F.lit(a), v)))
    return vectors.select(
        *(c.alias(n) for n, c in texts.items()), made.alias("labels"), F.array_except(F.map_values(made), F.array(F.lit(UNKNOWN))).alias("tokens"),
        F.lit("approved").alias("review"), F.lit("model").alias("label_source"), F.col("embedding").cast("array<float>"),
    )


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recommended from all vectors for every query vector and a text."""
    vectors = table(spark, sf_dir, "embeddings")
    text = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod(F.floor(F.col("vec_id") / 50), F.lit(len(SENTENCES))) + 1).cast("int"))
    asked = vectors.filter(ASKED).select(F.col("vec_id").alias("query"), text.alias("text"), F.col("embedding").alias("vector"))
    return recommend_all(vector_records(vectors), asked, PipelineConfig(candidate_k=20, preference_widen_k=80))


@query()
def recommend_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole recommendation from all vectors for every query vector: parsing, search, filters, ranking, choice and widening."""
    found = recommended(spark, sf_dir)
    out = found.select("query", "p.text", "status", F.array_join(F.col("trail").cast("array<string>"), ",").alias("trail"), F.posexplode_outer("selected").alias("pos", "s"))
    return out.select("query", "text", "status", "trail", (F.col("pos") + 1).alias("rank"), "s.id", "s.name", F.round("s.score", 6).alias("score"), F.col("s.row.evidence").alias("evidence"))


@query(
    """SELECT p_partkey, contains(' ' || p_name || ' ', ' ring ') OR p_type = 'ring' AS ring, len(string_split(p_name, ' '))::INTEGER AS n_words FROM part"""
)
def exact_word_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term given by a column, never matched inside a word."""
    hit = mentions(F.lit("ring"), F.col("p_name"), F.col("p_type"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("ring"), F.size(words(F.col("p_name"))).alias("n_words"))
