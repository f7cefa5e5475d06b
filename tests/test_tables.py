"""Orders, name variants and the service's calls on literal fixtures."""

import random

import pytest
from pyspark.sql import functions as F
from tests.test_engine import recommender

from tessera.functions.text import TEXT_VARIANTS, company, embedding_text, key_tokens, menu_key, same_menu
from tessera.operators.ordering import deduplicated_in_order, numbered, numbered_within
from tessera.operators.sampling import conflict_free_batches
from tessera.operators.variants import name_variants
from tessera.plans.catalogue import identity_index
from tessera.plans.recommend import PipelineConfig
from tessera.plans.service import Service


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_places_in_a_global_order(spark, ranges):
    rng = random.Random(2)
    rows = [(i, rng.randrange(40) if i % 3 else 5, None if i % 50 == 0 else f"t{i}") for i in range(500)]  # a third has one value
    df = spark.createDataFrame(rows, "i long, v long, position string").drop("position")
    got = numbered(df, [F.asc("v"), F.desc("i")], "place", ranges).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(500))
    assert [(r["v"], r["i"]) for r in got] == sorted(((v, i) for i, v, _ in rows), key=lambda x: (x[0], -x[1]))
    assert numbered(df.limit(0), [F.asc("v")]).count() == 0


def test_places_within_groups(spark):
    rng = random.Random(3)
    rows = [(None if i % 17 == 0 else 7 if i % 3 else rng.randrange(9), rng.randrange(1000), i) for i in range(300)]
    got = numbered_within(spark.createDataFrame(rows, "g long, v long, i long"), ["g"], [F.asc("v"), F.asc("i")], "place", 6).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r[2]] = place
    assert {r["i"]: r["place"] for r in got} == want


@pytest.mark.parametrize("ranges", [None, 5])
def test_batches_repeat_no_value(spark, ranges):
    """A third of the pairs share one left value, some share a right one, some are repeated."""
    rng = random.Random(6)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 90), 5 if i % 7 == 0 else rng.randrange(80)) for i in range(900)] + [(1, 1)] * 5 + [(None, 3), (None, 4)]
    got = conflict_free_batches(spark.createDataFrame(rows, "q long, m long"), "q", "m", 8, ranges=ranges).collect()
    assert sorted(((r["q"], r["m"]) for r in got), key=str) == sorted(rows, key=str)
    batches: dict = {}
    for r in got:
        batches.setdefault(tuple(r["batch"]), []).append((r["q"], r["m"]))
    for batch in batches.values():
        assert len(batch) <= 8 and len({q for q, _ in batch}) == len(batch) == len({m for _, m in batch})
    assert conflict_free_batches(spark.createDataFrame([], "q long, m long"), "q", "m", 8).count() == 0


def test_kept_rows_return_to_the_order_of_the_input(spark):
    rows = [(0, "c5", "x"), (1, "c1", "y"), (2, "c3", "x"), (3, "c2", None), (4, "c9", None), (5, "c0", "x")]
    kept, moved = deduplicated_in_order(spark.createDataFrame(rows, "row long, code string, text string"), ["text"], "code", "row")
    assert [(r["code"], r["position"]) for r in kept.orderBy("position").collect()] == [("c1", 0), ("c2", 1), ("c0", 2)]
    assert {(r["code"], r["kept_code"]) for r in moved.collect()} == {("c5", "c0"), ("c3", "c0"), ("c9", "c2")}


def test_variants_equal_the_rule_for_every_pair(spark):
    rng = random.Random(4)
    words = ["hot", "ring", "big", "두부", "찌개", "hotring"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.choice(["", "-", "Acme", "해당없음"])) for _ in range(70)]
    rows += [("", ""), (None, ""), ("  ", "Acme"), ("hot", "Acme"), ("hotter", "Acme"), ("hot ter", "Acme")]
    df = spark.createDataFrame(rows, "name string, company string")
    keys = df.select(menu_key(F.col("name")).alias("key"), company(F.col("company")).alias("company"), key_tokens(F.col("name")).alias("parts")).filter("key <> ''").distinct()
    structs = keys.select(F.struct("key", "company", "parts").alias("k"))
    pairs = structs.alias("a").crossJoin(structs.alias("b")).select("a.k", F.col("b.k").alias("other"), same_menu(F.col("a.k"), F.col("b.k")).alias("same")).collect()
    linked: dict = {}
    for p in pairs:
        a, b = p["k"], p["other"]
        if p["same"] and a != b:
            linked[a["key"], a["company"], tuple(a["parts"])] = linked.get((a["key"], a["company"], tuple(a["parts"])), 0) + 1
    got = name_variants(df, "name", "company").collect()
    assert len(got) == keys.count() and sum(r["n"] for r in got) == sum(bool((n or "").strip()) for n, _ in rows)
    # The rule holds for a pair if one begins the other in one company, or if the keys are equal; a pair may meet both ways.
    assert sum(r["shorter"] for r in got) == sum(r["longer"] for r in got)
    both = sum(1 for p in pairs if p["same"] and p["k"] != p["other"] and p["k"]["key"] == p["other"]["key"] and p["k"]["company"] == p["other"]["company"] and begins(p["k"], p["other"]))
    assert sum(r["shorter"] + r["longer"] + r["equal"] for r in got) - both == sum(linked.values())
    assert name_variants(df.limit(0), "name", "company").count() == 0


def begins(a, b):
    if a["company"]:
        return False  # one key is one node
    n = min(len(a["parts"]), len(b["parts"]))
    return a["parts"] != b["parts"] and a["parts"][:n] == b["parts"][:n]


def test_text_variants_are_a_registry(spark):
    one = spark.range(1).withColumns({"n": F.lit("이름"), "r": F.lit("대표"), "c": F.lit("분류")})
    TEXT_VARIANTS["C"] = lambda name, representative, category, labels: F.concat_ws("/", category, name)
    try:
        assert one.select(embedding_text("C", F.col("n"), F.col("r"), F.col("c"))).first()[0] == "분류/이름"
    finally:
        del TEXT_VARIANTS["C"]
    with pytest.raises(ValueError, match="there are A, B"):
        embedding_text("C", F.col("n"), F.col("r"), F.col("c"))


def test_service_calls(spark, tmp_path):
    dishes = [(f"요리{i}", f"요리{i}", "밥류", {"매운맛": "없음"}) for i in range(8)]
    index = identity_index(spark, dishes).cache()
    models = [("base", recommender(index, PipelineConfig(candidate_k=8))), ("swapped", recommender(index, PipelineConfig(candidate_k=8)))]
    at = 0
    service = Service(lambda: (models[at][1], models[at][0]), f"{tmp_path}/events")
    assert service.health() == {"ok": True, "model": "base", "feedback": 0}
    assert service.parse("피자 말고 매운 거") and {t["label"] for t in service.parse("매운 거")} == {"매운"}
    before = service.recommend("순한 요리", 3)
    assert len(before) == 3
    last = before[-1]["keyword"]
    for _ in range(4):
        service.feedback(" 순한 요리 ", last, liked=False, chosen=True)
    service.feedback("순한 요리", before[0]["keyword"], liked=False)
    after = service.recommend("순한 요리", 3)
    assert service.health()["feedback"] == 5 and after[0]["keyword"] == last and after[0]["score"] > before[-1]["score"]
    at = 1
    assert service.health()["model"] == "swapped"
    for wrong in (lambda: service.feedback("", "k", True), lambda: service.feedback("q", "", True), lambda: service.recommend("q", 11), lambda: service.parse("x" * 201)):
        with pytest.raises(ValueError):
            wrong()
