import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.sharding import capacities, plan, shard_rows, walks

from .fixtures import documents, empty


def test_counts_at_most_one_apart_and_slots_gapless(spark):
    docs = documents(spark)
    rows = shard_rows(docs, 8).collect()
    assert len(rows) == docs.count()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)


def test_rerun_and_partitioning_do_not_matter(spark):
    docs = documents(spark, nulls=False)
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_rows(docs, 5).collect()}
    assert a == {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_rows(docs.repartition(7), 5).collect()}


def test_like_one_key_at_a_time_in_turns():
    """Against a version that moves single keys: in each turn all waiting keys try their walk's next shard."""
    orders, counts = walks(4, 8, 6), {a: 1 + a % 5 for a in range(64)}
    room = capacities(sum(counts.values()), 4)
    got = {(arc, r): shard for arc, first, last, shard, _ in plan(counts, orders, room) for r in range(first, last + 1)}
    filled, waiting, want = [0] * 4, [(a, r) for a in range(64) for r in range(1, counts[a] + 1)], {}
    for turn in range(4):
        late = []
        for arc, r in waiting:
            s = orders[arc][turn]
            if filled[s] < room[s]:
                filled[s] += 1
                want[arc, r] = s
            else:
                late.append((arc, r))
        waiting = late
    assert got == want and not waiting


def test_one_more_shard_moves_little(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    a, b = ({r["doc_id"]: r["shard"] for r in shard_rows(docs, k).collect()} for k in (8, 9))
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert moved < 0.35  # a hash modulo the number of shards moves 89 %


def test_a_shared_text_is_spread(spark):
    rows = shard_rows(spark.range(900).selectExpr("id AS doc_id", "'same' AS text"), 8).collect()
    assert len({r["shard"] for r in rows}) == 8


def test_empty_and_tiny(spark):
    assert shard_rows(empty(spark), 8).count() == 0
    assert [r["slot"] for r in shard_rows(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 8).collect()] == [0, 0]


def test_only_native_operators(spark):
    plan_ = shard_rows(documents(spark), 8)._jdf.queryExecution().toString()
    assert "Python" not in plan_ and "Arrow" not in plan_ and "Pandas" not in plan_


def test_one_id_or_text_in_a_third_of_the_rows_is_spread(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "same" if i % 3 == 2 else f"text {i}" * (2000 if i == 5 else 1)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(3), "size": F.lit("x"), "arc": F.lit(1)})
    found = shard_rows(docs, 6).collect()
    assert Counter(r["shard"] for r in found) == dict.fromkeys(range(6), 150)
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(t) + 1) for i, t in rows)
    assert len({r["shard"] for r in found if r["doc_id"] == 7}) == 6
