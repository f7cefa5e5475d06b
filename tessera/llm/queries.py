"""One query per operator (``opN_<name>``) over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ann import nearest
from tessera.llm.embed_dedup import linked_vectors
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.html_extract import extract_main_text
from tessera.llm.merkle import proved_documents
from tessera.llm.mixing import cycle, mix
from tessera.llm.packing import packed_sequences
from tessera.llm.quality import fold, train, with_score
from tessera.llm.sharding import shard_rows
from tessera.llm.simhash import simhash_groups
from tessera.llm.token_counts import token_counts
from tessera.llm.token_files import token_round_trip
from tessera.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 with row counts at most one apart."""
    placed = shard_rows(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors at cosine 0.95."""
    return linked_vectors(_table(spark, sf_dir, "embeddings"), least=0.95)


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to seekable archives, and what they hold when read back."""
    return round_trip(_table(spark, sf_dir, "pages"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, 4 bits."""
    found = simhash_groups(_table(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document against a limit of 2,048 tokens, and how much of it stays within."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 1,024 tokens."""
    return packed_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


def op8_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources at weights 3, 1, 2 takes from every document, 150 % of all words in total."""
    taken = mix(_table(spark, sf_dir, "documents"), F.array("source"), cycle([3, 1, 2]), share=1.5, most=2)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, against all rows; every seventh id has a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 50 == 0, label=label)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written to Simple-8b files, and what they hold when read back."""
    return token_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document, a part of them tampered with."""
    return proved_documents(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hash_ring_shards": op1_hash_ring_shards,
        "op2_linked_vectors": op2_linked_vectors,
        "op3_warc_bundles": op3_warc_bundles,
        "op4_main_text": op4_main_text,
        "op5_simhash_groups": op5_simhash_groups,
        "op6_token_counts": op6_token_counts,
        "op7_packed_sequences": op7_packed_sequences,
        "op8_mixed_sources": op8_mixed_sources,
        "op9_quality_scores": op9_quality_scores,
        "op10_nearest_vectors": op10_nearest_vectors,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_token_files": op12_token_files,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


_OP2_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON a = c.vec_id"""

_OP3_SQL = """WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d),
x AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::INT) AS parts FROM m)
SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda p: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((p >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM x"""

_OP11_SQL = """WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM t a JOIN t b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3"""

# The checksum of the id's digits, bit by bit; levels by recursion until one node is left; then every leaf's way up.
_OP13_SQL = """WITH RECURSIVE d AS (SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS c FROM documents),
t AS (SELECT doc_id, lang, xor(c, 4294967295::UBIGINT) % 7 = 0 AS touched, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS b1, coalesce(strlen(text) || ':' || text, '-') AS e FROM d),
f AS (SELECT doc_id, lang, sha256(a || b || e) AS leaf, sha256(a || CASE WHEN touched THEN b1 ELSE b END || e) AS claim FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
g(lang, level, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM r UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM g WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM g WHERE n = 1),
o(level, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM o WHERE n > 1 GROUP BY level, pos // 2, n),
w(lang, leaf, i, level, j, n, proof, folded) AS (SELECT lang, leaf, pos, 0, pos, n, '', claim FROM r UNION ALL
  SELECT w.lang, w.leaf, w.i, w.level + 1, w.j // 2, (w.n + 1) // 2, proof || coalesce(h, ''), sha256(CASE WHEN w.j % 2 = 1 THEN coalesce(h, '') || folded ELSE folded || coalesce(h, '') END)
  FROM w LEFT JOIN g ON g.lang IS NOT DISTINCT FROM w.lang AND g.level = w.level AND g.pos = xor(w.j, 1) WHERE w.n > 1),
v(lang, leaf, i, level, j, n, proof, folded) AS (SELECT w.lang, w.leaf, w.i, 0, s.pos, s.n, proof, folded FROM w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1 UNION ALL
  SELECT v.lang, v.leaf, v.i, v.level + 1, v.j // 2, (v.n + 1) // 2, proof || coalesce(h, ''), sha256(CASE WHEN v.j % 2 = 1 THEN coalesce(h, '') || folded ELSE folded || coalesce(h, '') END)
  FROM v LEFT JOIN o ON o.level = v.level AND o.pos = xor(v.j, 1) WHERE v.n > 1),
z AS (SELECT h AS root FROM o WHERE n = 1)
SELECT r.doc_id, r.leaf, s.subroot, z.root, sha256(v.proof) AS proof_sha256, v.folded AS folded_root, v.folded = z.root AS verified
FROM r JOIN v ON v.n = 1 AND v.lang IS NOT DISTINCT FROM r.lang AND v.i = r.pos JOIN s ON s.lang IS NOT DISTINCT FROM r.lang CROSS JOIN z"""


def oracle_sql() -> dict[str, str]:
    """The others rest on hashes, trained models, tokenizers or graphs that SQL has not; tests compare them with brute force."""
    return {"op2_linked_vectors": _OP2_SQL, "op3_warc_bundles": _OP3_SQL, "op11_hard_negatives": _OP11_SQL, "op13_merkle_manifest": _OP13_SQL}
