"""Ranking, recommendation, preparation, stores and feedback on literal fixtures."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions.text import family, is_test_query, menu_key, parse_name, parse_quantity, same_menu
from tessera.operators.evaluation import bootstrap_draws, condensed, kappa, paired_bootstrap, per_query
from tessera.operators import profile
from tessera.operators.ranking import Penalised, RankingConfig, _best, choice_columns, drop_reasons, select_top_k, top_k_similar
from tessera.operators.sampling import packed_batches, sqrt_quotas
from tessera.operators.reports import observe_lists
from tessera.plans import catalogue, food
from tessera.plans.catalogue import SENTENCES, identity_index, vector_records
from tessera.plans.experiments import ITEMS, build_pool, diversity_grid, range_grid
from tessera.plans.parser import parse, tags
from tessera.plans import recommend
from tessera.plans.recommend import EMBEDDING_ONLY, PipelineConfig, Recommender, check_request, pick_menus, recommend_all
from tessera.plans.report_queries import parser_coverage_summary
from tessera.schema import FEEDBACK, Condition
from tessera.sources.tables import add_column_if_missing, append_jsonl, current_table, read_csv, read_or_empty, read_pointer, write_pointer, write_sheet, write_with_backup
from tessera.sources.vector_store import ModelSpec, StoreError, VectorStore, encode, result_name, store_config
from tessera.streaming import feedback

# --- names and cleaning


def test_names(spark):
    rows = [("라떼_아이스 (ICED)(L)", True), ("김치_찌개", False), ("(HOT)", True), ("버거_불고기 (신)", True), ("피자(L)(M)", False), ("  두부  찌개 ", False)]
    got = spark.createDataFrame(rows, "n string, f boolean").select(parse_name(F.col("n"), F.col("f")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [
        ("라떼_아이스 (ICED)(L)", "라떼", "ICED", "L"), ("김치 찌개", None, None, None), ("(HOT)", None, "HOT", None), ("불고기 (신)", "버거", None, None), ("피자 (M)", None, None, "L"), ("두부 찌개", None, None, None),
    ]


def test_quantities(spark):
    got = spark.createDataFrame([("100g",), ("291.90 ML",), ("1인분",), (None,)], "q string").select(parse_quantity(F.col("q")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [(100.0, "g"), (291.9, "ml"), (None, None), (None, None)]


def test_menu_groups_and_sides(spark):
    rows = [("밥류", "비빔밥", "식사"), ("빵 및 과자류", "피자", "식사"), ("빵 및 과자류", "케이크", "디저트"), ("볶음류", "감자볶음", "반찬"), ("볶음류", "감자탕볶음", "식사"), ("조림류", "장조림", "반찬"), ("음료 및 차류", "차", "음료"), ("없음", None, "기타")]
    got = spark.createDataFrame(rows, "c string, r string, w string").select(food.menu_group(F.col("c"), F.col("r")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_cleaning_keeps_the_smallest_code_and_maps_the_others(spark):
    base = {c: 1.0 for c in food.NUTRIENTS} | {"식품명": "국밥", "업체명": "해당없음", "식품기원명": "o", "출처명": "s", "데이터생성방법명": "d", "영양성분함량기준량": "100g", "식품중량": "250g", "식품대분류명": "국 및 탕류", "대표식품명": "국밥", "식품중분류명": "해당없음"}
    rows = [base | {"식품코드": c, **more} for c, more in (("C", {}), ("A", {}), ("B", {"수분(g)": None}), ("D", {"수분(g)": None}), ("E", {"업체명": None}))]
    schema = ", ".join(f"`{k}` {'double' if k in food.NUTRIENTS else 'string'}" for k in rows[0])
    kept, moved = food.clean(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    assert kept.columns == food.COLUMNS
    assert {(r["식품코드"], r["업체명"], r["프랜차이즈여부"], r["중량값"]) for r in kept.collect()} == {("A", None, False, 250.0), ("B", None, False, 250.0), ("E", None, True, 250.0)}
    assert {(r["식품코드"], r["대표식품코드"]) for r in moved.collect()} == {("C", "A"), ("D", "B")}
    units = food.units(food.meals(kept)).collect()
    assert sum(r["n"] for r in units) == 3 and len({r["unit_id"] for r in units}) == len(units) == 1


def test_same_menu_is_not_transitive(spark):
    names = ["A", "A B", "A C", "콤비네이션 피자", "콤비네이션피자"]
    table = spark.createDataFrame([(n, "") for n in names], "name string, company string").withColumn("representative", F.lit("")).select("name", choice_columns(RankingConfig())["_key"].alias("k"))
    pairs = table.alias("x").crossJoin(table.alias("y")).select(F.col("x.name"), F.col("y.name"), same_menu(F.col("x.k"), F.col("y.k")).alias("s")).collect()
    same = {(r[0], r[1]) for r in pairs if r["s"]}
    assert ("A", "A B") in same and ("A", "A C") in same and ("A B", "A C") not in same and ("콤비네이션 피자", "콤비네이션피자") in same


def test_keys_families_and_holdout(spark):
    one = spark.range(1).select(menu_key(F.lit("치즈크러스트 피자 (L)")).alias("k"), family(F.lit("붕어 매운탕"), F.lit("-")).alias("f"), family(F.lit("불고기 피자"), F.lit("도미노")).alias("g"), is_test_query(F.lit("abc")).alias("t")).first()
    import hashlib

    assert (one["k"], one["f"], one["g"], one["t"]) == ("피자", "매운탕", "불고기 피자", int(hashlib.md5(b"abc").hexdigest(), 16) % 3 == 0)


# --- ranking


def scored(spark, rows):
    return spark.createDataFrame([(0, i, n, r, c, float(s), 0.0) for i, n, r, c, s in rows], "q int, id string, name string, representative string, company string, score double, sim double")


def chosen(spark, rows, k, config=RankingConfig(), exempt=None):
    out = select_top_k(scored(spark, rows), k, config, ["q"], exempt).first()
    return [s["id"] for s in out["selected"]], [(s["id"], s["reason"]) for s in out["skipped"]]


def test_choice_skips_variants_and_full_groups(spark):
    rows = [("a", "두부찌개", "찌개", "", 9), ("b", "두부찌개 바지락", "찌개", "", 8), ("c", "김치찌개", "찌개", "", 7), ("d", "된장찌개", "찌개", "", 6), ("e", "냉면", "냉면", "", 5), ("f", "우동", "우동", "", 4)]
    assert chosen(spark, rows, 3) == (["a", "c", "e"], [("b", "duplicate: 두부찌개"), ("d", "representative cap(2): 찌개")])
    assert chosen(spark, rows, 4, exempt=F.array(F.lit("찌개")))[0] == ["a", "c", "d", "e"]
    assert chosen(spark, rows, 2, RankingConfig(group_cap=0, collapse_duplicates=False))[0] == ["a", "b"]


def test_group_penalty_seeks_the_best_anew(spark):
    rows = [("p1", "p one", "p", "x", 1.0), ("p2", "p two", "p", "x", 0.95), ("s1", "s one", "s", "x", 0.9)]
    config = RankingConfig(group_cap=0, collapse_duplicates=False, group_penalty=0.1)
    assert chosen(spark, rows, 2, config)[0] == ["p1", "s1"]
    assert chosen(spark, rows, 2, RankingConfig(group_cap=0, collapse_duplicates=False, group_penalty=0.01))[0] == ["p1", "p2"]


def plain_penalised(rows, k, config):
    """The best is sought in the whole list at every step."""
    left, taken, out = sorted(rows, key=lambda r: (-round(r[4], 9), -r[5], r[0])), [], []
    left = [dict(id=i, name=n, group=r.split()[-1] if not c and r.split() else r, key=n.split(), company=c, score=s, pos=p) for p, (i, n, r, c, s, _) in enumerate(left)]
    while left and len(taken) < k:
        x = min(left, key=lambda y: (-(y["score"] - config.group_penalty * sum(t["group"] == y["group"] for t in taken)), y["pos"]))
        left.remove(x)
        short = lambda t: min(len(t["key"]), len(x["key"]))  # noqa: B023, E731
        if config.collapse_duplicates and any(t["key"][: short(t)] == x["key"][: short(t)] for t in taken):
            out.append(x["id"])
        elif config.group_cap and sum(t["group"] == x["group"] for t in taken) >= config.group_cap:
            out.append(x["id"])
        else:
            taken.append(x)
    return [t["id"] for t in taken], out


def test_penalised_choice_like_a_plain_search(spark):
    rng = np.random.default_rng(8)
    for penalty, cap, collapse, n in ((0.05, 0, False, 80), (0.3, 2, True, 120), (0.02, 3, True, 60), (1.0, 1, False, 40)):
        rows = [(f"i{i:03d}", " ".join(f"w{rng.integers(5)}" for _ in range(rng.integers(1, 4))), f"g{rng.integers(6)}", "", float(np.round(rng.random(), 2)), 0.0) for i in range(n)]
        config = RankingConfig(group_cap=cap, collapse_duplicates=collapse, group_penalty=penalty)
        got = chosen(spark, [r[:5] for r in rows], 7, config)
        assert (got[0], [i for i, _ in got[1]]) == plain_penalised(rows, 7, config)


def test_a_long_list_is_read_only_as_far_as_needed(spark):
    """100,000 records, a third of one group: the choice stops early and equals the plain search over the head that it needs."""
    rng = np.random.default_rng(9)
    rows = [(f"i{i:06d}", f"name{i}", "hot" if i % 3 == 0 else f"g{i % 997}", "", float(s), 0.0) for i, s in enumerate(rng.random(100_000))]
    config = RankingConfig(group_cap=0, collapse_duplicates=True, group_penalty=0.01)
    head = sorted(rows, key=lambda r: -r[4])[:400]
    assert chosen(spark, [r[:5] for r in rows], 10, config)[0] == plain_penalised(head, 10, config)[0]
    read = 0
    choice = Penalised(10, config)
    for pos, r in enumerate(sorted(rows, key=lambda r: -r[4])):
        read += 1
        if not choice.feed({"pos": pos, "id": r[0], "name": r[1], "score": r[4], "group": r[2], "key": {"key": r[1], "company": "", "parts": [r[1]]}, "free": False, "reason": "", "row": None}):
            break
    assert read < 500


def test_unknown_fails_and_says_so(spark):
    rows = spark.createDataFrame([({"a": "1"},), ({"a": ""},), ({"b": "1"},)], "labels map<string,string>")
    got = [r["r"] for r in rows.select(drop_reasons(F.col("labels"), [Condition("a", ("1",))]).alias("r")).collect()]
    assert got[0] == [] and all(r[0]["unknown"] and r[0]["value"] == "미확인" for r in got[1:])


# --- recommendation on an index of unit axes

HOT, COLD = {"매운맛": "강함", "국물": "국물요리"}, {"매운맛": "없음", "국물": "국물없음"}
NAMES = [(f"메뉴{i} 요리{i}", f"요리{i}", "국 및 탕류", HOT if i < 5 else COLD) for i in range(8)]


@pytest.fixture(scope="module")
def index(spark):
    return identity_index(spark, NAMES).cache()


def recommender(index, config):
    v = np.arange(8, 0, -1.0)
    return Recommender(index, lambda _: (v / np.linalg.norm(v)).tolist(), config)


def test_widening_trails(index):
    few = recommender(index, PipelineConfig(top_k=3, candidate_k=4)).recommend("맵지 않은 거")
    assert few.trail == [4, 8] and [r["id"] for r in few.items] == ["u5", "u6", "u7"] and few.drop_reasons == {"매운맛=강함": 5}
    soft = recommender(index, PipelineConfig(top_k=2, candidate_k=2, preference_widen_k=8)).recommend("순한 거")
    assert soft.trail == [2, 4, 8] and [r["id"] for r in soft.items] == ["u5", "u6"]
    plain = recommender(index, PipelineConfig(top_k=2, candidate_k=2)).recommend("아무거나")
    assert plain.trail == [2] and plain.status == "ok"


def test_statuses(index):
    engine = recommender(index, PipelineConfig(top_k=5, candidate_k=8))
    assert engine.recommend(" ").status == "empty_query"
    assert engine.recommend("맵지 않은데 아주 매운").status == "contradiction"
    short = engine.recommend("맵지 않은 거")
    assert short.status == "shortage" and len(short.items) == 3
    assert [m["keyword"] for m in pick_menus(short, 2, lambda k: 1.0 if k == "요리7" else 0.0)] == ["요리7", "요리5"]
    assert [r["id"] for r in engine.recommend("맵지 않은 거", EMBEDDING_ONLY).items][:2] == ["u0", "u1"]


# --- evaluation


def test_metrics(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank int")
    grades = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "z", 2)], "query string, id string, grade int")
    m = per_query(results, grades, 3).first()
    ideal = 3 + 3 / np.log2(3) + 1 / 2
    assert (m["returned"], m["unjudged"], m["rr"]) == (3, 1, 0.5) and m["precision"] == pytest.approx(1 / 3) and m["ndcg"] == pytest.approx((1 + 3 / np.log2(3)) / ideal)
    c = condensed(results, grades, results).first()
    assert c["recall"] == pytest.approx(0.5)


def test_bootstrap_and_kappa(spark):
    same = paired_bootstrap(spark.createDataFrame([(str(i), 0.1) for i in range(9)], "query string, diff double"), 100).first()
    assert same["low"] == pytest.approx(0.1) and not same["holds_zero"]
    with pytest.raises(ValueError):
        paired_bootstrap(spark.createDataFrame([], "query string, diff double"))
    pairs = spark.createDataFrame([(0, 0)] * 4 + [(1, 1)] * 4 + [(0, 1), (1, 0)], "a int, b int")
    assert kappa(pairs, "a", "b", [0, 1]).first()["kappa"] == pytest.approx(0.6)


def test_quotas_and_batches(spark):
    quotas = {r["k"]: r["quota"] for r in sqrt_quotas(spark.createDataFrame([("a", 100), ("b", 1), ("c", 25)], "k string, n long"), 16, "k").collect()}
    assert quotas == {"a": 10, "b": 1, "c": 5}
    assert packed_batches([("q", "d"), ("q", "e"), ("r", "d"), ("s", "f")], 2) == [[("q", "d"), ("s", "f")], [("q", "e"), ("r", "d")]]


# --- sources


def test_sheets_and_logs(spark, tmp_path):
    path = str(tmp_path / "sheet")
    write_sheet(spark.createDataFrame([("x", None, "drop")], "a string, b string, z string"), path, ["a", "b", "c"])
    got = read_csv(spark, path)
    assert got.columns == ["a", "b", "c"] and tuple(got.first()) == ("x", None, None)
    (tmp_path / "bom.csv").write_bytes("﻿가,b\n1,\"x\ny\"\n".encode())
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "bom.csv")).collect()] == [("1", "x\ny")]
    log = str(tmp_path / "log")
    assert read_or_empty(spark, log, FEEDBACK).count() == 0
    for _ in range(2):
        append_jsonl(spark.createDataFrame([Row(id=1, query="q")]), log)
    assert read_or_empty(spark, log, FEEDBACK).count() == 2
    table = str(tmp_path / "t")
    assert write_with_backup(spark.range(1), table) is None
    backup = write_with_backup(spark.range(2), table)
    assert spark.read.parquet(table).count() == 2 and spark.read.parquet(backup).count() == 1
    assert current_table(spark, table) == table
    os.rename(table, f"{table}.lost")  # as if the driver had ended between the two moves
    assert spark.read.parquet(current_table(spark, table)).count() == 1 and write_with_backup(spark.range(3), table) is None
    assert spark.read.parquet(current_table(spark, table)).count() == 3 and current_table(spark, f"{table}.none") == f"{table}.none"
    assert add_column_if_missing(spark.range(1), "chosen", "int", 0).first()["chosen"] == 0
    pointer = str(tmp_path / "current.json")
    assert read_pointer(spark, pointer) == {}
    for name in ("l", "m"):
        write_pointer(spark, pointer, {"dir": name})
    assert read_pointer(spark, pointer) == {"dir": "m"}


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "t"), ("b", "u")], "id string, text string")
    vectors = encode(rows, "text", lambda: lambda texts: np.array([[1.0, len(t)] for t in texts]))
    config = {"model": "m", "dimension": 2}
    store.save("one", vectors, config)
    assert store.load("one", config).count() == 2 and store.reuse_check("one", config)["reusable"]
    with pytest.raises(StoreError):
        store.save("one", vectors, config)
    with pytest.raises(StoreError):
        store.save("one", vectors, config | {"model": "n"}, overwrite=True)
    store.save("one", vectors, config, overwrite=True)
    assert store.reuse_check("one", config | {"model": "n"})["differences"] == {"model": ["m", "n"]} and [m["name"] for m in store.catalogue()] == ["one"]
    for bad in ([float("nan"), 0.0], [2.0, 0.0], [1.0]):
        with pytest.raises(StoreError):
            store.save("bad", spark.createDataFrame([("a", [1.0, 0.0]), ("b", bad)], "id string, embedding array<float>"), config)


# --- feedback


def test_feedback(spark, tmp_path):
    rows = [(1, "매운 국물", "국", 1, None), (2, "매운 국물", "국", 0, 1), (3, "매운 거", "국", 0, 0), (4, "매운 매운", "면", 1, 0)]
    events = spark.createDataFrame(rows, "id long, query string, keyword string, liked int, chosen int")
    counts = {(r["token"], r["keyword"]): (r["likes"], r["dislikes"]) for r in feedback.token_counts(events).collect()}
    assert counts == {("매운", "국"): (3, 1), ("국물", "국"): (3, 0), ("거", "국"): (0, 1), ("매운", "면"): (1, 0)}
    asked = spark.createDataFrame([("매운 국물 새것", "국"), ("", "국")], "query string, keyword string")
    boost = {r["query"]: r["boost"] for r in feedback.boosts(asked, feedback.token_counts(events)).collect()}
    assert boost["매운 국물 새것"] == pytest.approx(0.15 * (2 / 6 + 3 / 5 + 0) / 3) and boost[""] == 0
    assert {tuple(r) for r in feedback.liked_pairs(events).collect()} == {("매운 국물", "국"), ("매운 매운", "면")}
    table = str(tmp_path / "events")
    assert [feedback.append_once(events, table, "id"), feedback.append_once(events, table, "id")] == [4, 0]
    assert feedback.better({"ndcg": 0.51, "recall": 0.4}, {"ndcg": 0.5, "recall": 0.4}) and not feedback.better({"ndcg": 0.505, "recall": 0.5}, {"ndcg": 0.5, "recall": 0.4})


def test_boosts_send_no_text_along_with_each_word(spark):
    """Ten texts of 2,000 words: what is shuffled is in proportion to them, and pairs without words or without a text stay."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 2000)) for _ in range(10)]
    pairs = spark.createDataFrame([*((t, f"k{i % 2}") for i, t in enumerate(texts)), ("", "k0"), (None, "k1"), (texts[0], None)], "query string, keyword string")
    word = texts[0].split()[0]
    counts = spark.createDataFrame([(word, "k0", 8, 0)], "token string, keyword string, likes long, dislikes long")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = {(r["query"], r["keyword"]): r["boost"] for r in feedback.boosts(pairs, counts).collect()}
    assert shuffled() - before < 8_000_000
    assert got == {(t, f"k{i % 2}"): 0.0 for i, t in enumerate(texts)} | {("", "k0"): 0.0, (None, "k1"): 0.0, (texts[0], None): 0.0} | {(texts[0], "k0"): pytest.approx(0.15 * 0.8 / len(set(texts[0].split())))}


def test_bootstrap_by_draws_and_by_weights(spark):
    """Draws of Python's generator give the interval of a plain loop; weights give one about as wide."""
    rng = np.random.default_rng(2)
    values = [round(float(v), 6) for v in rng.normal(0.3, 1.0, 40)]
    diffs = spark.createDataFrame([(f"q{i:02d}", v) for i, v in enumerate(values)], "query string, diff double")
    draws = bootstrap_draws(40, 400, 5)
    means = sorted(sum(c * v for c, v in zip(d, values)) / 40 for d in draws)
    got = paired_bootstrap(diffs, 400, 5, draws=draws).first()
    assert (got["low"], got["high"], got["mean_diff"]) == pytest.approx((means[10], means[389], sum(values) / 40))
    by_weight = paired_bootstrap(diffs, 2000, 1).first()
    error = np.std(values) / np.sqrt(40)
    assert by_weight["low"] == pytest.approx(by_weight["mean_diff"] - 1.96 * error, abs=0.4 * error) and by_weight["high"] == pytest.approx(by_weight["mean_diff"] + 1.96 * error, abs=0.4 * error)
    assert by_weight["holds_zero"] == (by_weight["low"] <= 0 <= by_weight["high"])


@pytest.mark.parametrize("few", [100_000, 3])
def test_quantiles_without_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "FEW", few)
    monkeypatch.setattr(profile, "BINS", 8)
    rng = np.random.default_rng(6)
    columns = {"wide": np.exp(rng.normal(0, 30, 500)), "ties": np.where(rng.random(500) < 0.7, 3.0, rng.normal(0, 1, 500)), "same": np.full(500, -2.5), "huge": rng.choice([-1.7e308, 1.7e308, 0.0], 500), "near": 1 + rng.integers(0, 5, 500) * 2.0**-52}
    rows = [tuple(float(columns[c][i]) for c in columns) + (None,) for i in range(500)] + [(None, float("nan"), None, float("inf"), None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", none double")
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["column"], r["fraction"]): r["value"] for r in profile.quantiles(df, [*columns, "none"], fractions).collect()}
    want = {(c, f): float(np.quantile(v, f)) for c, v in columns.items() for f in fractions if c != "huge"}
    assert {k: v for k, v in got.items() if k[0] != "huge"} == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}
    assert got["huge", 0.0] == -1.7e308 and got["huge", 1.0] == 1.7e308 and profile.quantiles(df.limit(0), ["wide"], [0.5]).count() == 0


# --- experiments


def test_grid_pool_and_tags(spark, index):
    from tessera.plans.experiments import build_pool, compare_first, evaluate_grid, run_grid, weight_grid
    from tessera.plans.parser import register_tags

    engine = recommender(index, PipelineConfig(top_k=2, candidate_k=8))
    grid = run_grid({"base": engine}, ["맵지 않은 거"], {"full": engine.config, "plain": EMBEDDING_ONLY}, 2).cache()
    assert build_pool(grid).count() == 4
    grades = spark.createDataFrame([("맵지 않은 거", "u5", 2), ("맵지 않은 거", "u0", 0)], "query string, id string, grade int")
    got = {r["config"]: (r["precision"], r["mrr"], r["unjudged"]) for r in evaluate_grid(grid, grades, 2).collect()}
    assert got == {"full": (0.5, 1.0, 0.5), "plain": (0.0, 0.0, 0.5)}
    assert compare_first(grid, "full", "plain").first()["same"] is False
    assert len(weight_grid(engine.config, [0, 0.3], [0, 0.05, 0.15])) == 6
    register_tags(spark)
    assert {r["label"] for r in spark.sql("SELECT * FROM query_tags('피자 말고 매운 거')").collect()} == {"매운", "피자 말고"}


# --- tables of queries


def plain_recommendation(records, vectors, text, vector, config):
    """One query, step by step, in plain Python: parse, search, filter, score, choose, widen."""
    spec = parse(text)
    if not spec.text.strip() or spec.contradictions:
        return ("empty_query" if not spec.text.strip() else "contradiction"), [], []
    order = sorted(records, key=lambda i: (-round(float(np.dot(vectors[i], vector)), 9), i))
    known = lambda r, c: r["labels"].get(c.attribute) or "미확인"
    points = lambda r, t: t in (r["representative"], r["category"]) or t in r["name"].split() or t in r["category"].split()
    alias = {"밥": "밥류", "면": "면 및 만두류", "죽": "죽 및 스프류", "전": "전·적 및 부침류", "부침개": "전·적 및 부침류"}
    out_terms = [alias.get(e["term"], e["term"]) for e in spec.menu_exclusions]
    menu = [alias.get(t, t) for t in spec.menu_terms]
    context = [t["term"] for t in spec.context_terms if t["term"] not in spec.menu_terms]
    group = lambda r: r["representative"].split()[-1]
    free = {group(r) for r in records.values() if any(points(r, t) for t in menu + [alias.get(t, t) for t in context])}
    size, soft_limit = len(records), min(config.preference_widen_k, len(records))
    k, trail = min(max(config.candidate_k, 1), size), []
    while True:
        trail.append(k)
        scored = []
        for i in order[:k]:
            r = records[i]
            if any(known(r, c) not in c.allowed for c in spec.hard) or any(points(r, t) for t in out_terms):
                continue
            sim = round(float(np.dot(vectors[i], vector)), 9)
            pref = sum(known(r, c) in c.allowed for c in spec.soft) / len(spec.soft) if spec.soft else 0.0
            bonus = max(0.3 if any(points(r, t) for t in menu) else 0.0, 0.05 if any(points(r, alias.get(t, t)) for t in context) else 0.0)
            scored.append((-round(0.7 * sim + 0.3 * pref + bonus, 9), -sim, i, pref))
        taken, held = [], {}
        for _, _, i, pref in sorted(scored):
            words = [w.lower() for w in records[i]["name"].split()]
            if any(w[: min(len(w), len(words))] == words[: min(len(w), len(words))] for w in ([x.lower() for x in records[j]["name"].split()] for j, _ in taken)):
                continue
            g = group(records[i])
            if held.get(g, 0) >= 2 and g not in free:
                continue
            held[g] = held.get(g, 0) + 1
            taken.append((i, pref))
            if len(taken) == config.top_k:
                break
        if len(taken) < config.top_k and k < size:
            k = min(2 * k, size)
        elif spec.soft and k < soft_limit and sum(p >= 1 for _, p in taken) < config.top_k:
            k = min(2 * k, soft_limit)
        else:
            return ("ok" if len(taken) == config.top_k else "shortage"), trail, [i for i, _ in taken]


def test_recommendations_like_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 12))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist(), i % 8) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    index = vector_records(vectors).cache()
    records = {r["id"]: r.asDict() for r in index.drop("embedding").collect()}
    at = {f"{i:012d}": v.astype(np.float64) for i, v in enumerate(x)}
    texts = [*SENTENCES, None, "치킨 말고 매운 거", "꼭 매운 찌개", "냉면"]
    asked = spark.createDataFrame([(n, t, x[n].tolist()) for n, t in enumerate(texts)], "query long, text string, vector array<float>")
    config = PipelineConfig(candidate_k=5, preference_widen_k=40)
    found = recommend_all(index, asked, config).cache()
    seen = {r["query"]: r for r in observe_lists(found).collect()}
    for r in found.collect():
        status, trail, items = plain_recommendation(records, at, texts[r["query"]], x[r["query"]].astype(np.float64), config)
        assert (r["status"], list(r["trail"] or []), [s["id"] for s in r["selected"] or []]) == (status, trail, items), texts[r["query"]]
        o, spec = seen[r["query"]], parse(texts[r["query"]])
        known = lambda i, c: records[i]["labels"].get(c.attribute) or "미확인"  # noqa: B023, E731
        assert (o["returned"], o["violations"], o["duplicates"], o["widened_times"]) == (len(items), 0, 0, max(len(trail) - 1, 0))
        assert o["mismatched"] == sum(known(i, c) not in (*c.allowed, "미확인") for i in items for c in spec.soft)
        assert o["unknown"] == sum(any(known(i, c) == "미확인" for c in (*spec.hard, *spec.soft)) for i in items)
        assert o["repeated"] == len(items) - len({records[i]["representative"] for i in items})


@pytest.mark.parametrize("listed", [3, 64])
def test_recommendations_beyond_the_preferred_range_like_a_plain_loop(spark, monkeypatch, listed):
    """Few records pass, and those far behind: ranges go on to any rank and to the whole index, with short lists and long ones."""
    monkeypatch.setattr(recommend, "LISTED", listed)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 12))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = vector_records(spark.createDataFrame([(i, v.tolist(), i % 8) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).cache()
    records = {r["id"]: r.asDict() for r in index.drop("embedding").collect()}
    at = {f"{i:012d}": v.astype(np.float64) for i, v in enumerate(x)}
    texts = ["꼭 매운 거 먹고 싶어", "맵지 않고 따뜻한 국물", "꼭 매운 찌개", "냉면", "튀김 말고 담백한 한식"]
    asked = spark.createDataFrame([(n, t, x[n].tolist()) for n, t in enumerate(texts)], "query long, text string, vector array<float>")
    for config in (PipelineConfig(candidate_k=2, preference_widen_k=4), PipelineConfig(top_k=40, candidate_k=2, preference_widen_k=4)):
        trails = []
        for r in recommend_all(index, asked, config).collect():
            status, trail, items = plain_recommendation(records, at, texts[r["query"]], x[r["query"]].astype(np.float64), config)
            assert (r["status"], list(r["trail"] or []), [s["id"] for s in r["selected"] or []]) == (status, trail, items), texts[r["query"]]
            trails.append(trail)
        assert any(t[-1] > 4 for t in trails)


def test_texts_are_parsed_whole_in_batches_and_by_the_table_function(spark, tmp_path):
    rows = [(c, t, text) for c in range(6) for t, text in enumerate(["hello there " * 400, None, "맵지 않은 " * 3])]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    texts = {(c, t): " ".join(x for x in (text, SENTENCES[(c + t) % len(SENTENCES)]) if x is not None) for c, t, text in rows}
    for r in catalogue.query_parse_table(spark, str(tmp_path)).collect():
        spec = parse(texts[r["conv_id"], r["turn"]])
        assert [(c["attribute"], tuple(c["allowed"])) for c in r["hard"]] == [(c.attribute, c.allowed) for c in spec.hard] and list(r["menu_terms"]) == spec.menu_terms
    want = sorted((c, t, x["label"], x["group"], x["avoid"]) for (c, t), text in texts.items() for x in tags(parse(text)))
    assert sorted(tuple(r) for r in catalogue.query_tags(spark, str(tmp_path)).collect()) == want
    cover = parser_coverage_summary(spark, str(tmp_path)).first()
    specs = [parse(t) for t in texts.values()]
    assert (cover["n"], cover["with_hard"], cover["with_menu"], cover["with_unhandled"]) == (18, sum(bool(s.hard) for s in specs), sum(bool(s.menu_terms) for s in specs), sum(bool(s.unhandled) for s in specs))


def test_search_leaves_out_what_it_cannot_compare(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0]), (3, [1.0, None]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [float("inf"), 0.0]), (9, [0.0, float("-inf")])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = [(r["query_id"], r["id"], r["sim"]) for r in top_k_similar(df.filter("id < 2 or id > 4"), df, 2, "id", "id", exclude_self=True).orderBy("query_id", "rank").collect()]
    assert got == [(0, 6, 1.0), (0, 7, 1.0), (1, 0, 0.0), (1, 6, 0.0), (6, 0, 1.0), (6, 7, 1.0), (7, 0, 1.0), (7, 6, 1.0)]
    assert top_k_similar(df.limit(0), df, 2, "id", "id").count() == 0 and top_k_similar(df, df.limit(0), 2, "id", "id").count() == 0


def test_blocks_with_few_finite_products():
    """Products that are no numbers don't hide the others, in blocks with fewer than k finite ones too."""
    nan, inf = float("nan"), float("inf")
    for sims, k, want in (([[nan, nan, nan, 0.3, 0.2]], 3, [3, 4]), ([[inf, 0.1, -inf]], 1, [1]), ([[nan]], 2, []), ([[0.5, 0.5, nan, 0.7]], 2, [3, 0])):
        assert _best(np.array(sims), k)[1].tolist() == want


# --- stored indexes


def test_an_index_is_found_checked_and_cut_to_its_scope(spark, tmp_path):
    store, spec = VectorStore(spark, f"file:{tmp_path}/store"), ModelSpec("org/Some Model", "abcdef0123", 8)
    hashes = {"units.csv": "1", "labels.jsonl": "2"}
    config = store_config(spec, "B", hashes)
    name = result_name(spec, "B", config)
    assert name.startswith("some-model_abcdef01_B_")
    with pytest.raises(StoreError):
        store.find(spec, "B")
    names = [*NAMES[:6], ("쌀밥", "쌀밥", "밥류", HOT), ("버거", "버거", "빵 및 과자류", COLD)]
    rows = identity_index(spark, names).withColumn("company", F.when(F.col("id") == "u7", "회사").otherwise(""))
    store.save(name, rows, config)
    open(f"{tmp_path}/store/old-result.npy", "w").close()
    assert {"name": "old-result", "unmanaged": True} in store.catalogue()
    index, ref = food.load_index(store, "B", spec, hashes)
    assert index.count() == 6 and ref["scope"] == {"companies": False, "staples": False, "n": 6, "of": 8, "given": 0} and ref["model_id"] == "org/Some Model"
    assert food.load_index(store, "B", spec, hashes, companies=True, staples=True)[0].count() == 8
    for other, changed in ((replace(spec, pooling="cls"), hashes), (spec, hashes | {"units.csv": "9"})):
        with pytest.raises(StoreError):
            food.load_index(store, "B", other, changed)
    placed = lambda ids: spark.createDataFrame(list(enumerate(ids)), "position long, id string")
    assert [food.active_index(placed("abc"), s)[1] for s in (None, placed("abc"), placed("acb"), placed("ab"))] == ["base", "swapped", "base", "base"]


def test_requests_out_of_bounds(spark):
    check_request(query="x", keyword="k", menu="", place_id="", limit=10)
    for wrong in ({"query": ""}, {"query": "x" * 201}, {"keyword": "k" * 51}, {"menu": "m" * 101}, {"place_id": "p" * 31}, {"limit": 0}, {"limit": 11}):
        with pytest.raises(ValueError):
            check_request(**wrong)


def test_pools_and_grids_keep_the_first_finding():
    base = PipelineConfig()
    assert len(diversity_grid(base, [1, 2, 3], [0.0, 0.1, 0.2])) == 9 and [c.candidate_k for c in range_grid(base, [5, 10]).values()] == [5, 10]


def test_pool_in_order(spark):
    rows = [(0, "a", "x", "q", "1", "first", "", "", "", 1, 0.5, "ok"), (1, "a", "y", "q", "1", "second", "", "", "", 1, 0.5, "ok"), (2, "a", "y", "q", "2", "other", "", "", "", 2, 0.4, "ok")]
    assert [(r["id"], r["name"]) for r in build_pool(spark.createDataFrame(rows, ITEMS)).orderBy("pos").collect()] == [("1", "first"), ("2", "other")]
