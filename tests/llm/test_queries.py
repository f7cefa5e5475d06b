"""The registered queries: SQL where there is some, schemas for all."""

import duckdb
import pytest

from tessera.llm.queries import oracle_sql, queries

SCHEMAS = {
    "op1_hash_ring_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_linked_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_warc_bundles": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_simhash_groups": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean", "kept_chars": "bigint", "kept_tokens": "bigint"},
    "op7_packed_sequences": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_mixed_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_quality_scores": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_nearest_vectors": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op13_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
}


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_schema_and_sql(spark, small, name):
    df = queries()[name](spark, small)
    assert dict(df.dtypes) == SCHEMAS[name]
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("embeddings", "pages", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        cursor = con.execute(oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()), key=str)
        assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_every_query_is_registered():
    assert set(queries()) == set(SCHEMAS)
