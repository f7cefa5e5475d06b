import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.mixing import Flow, cycle, mix, route, source_targets
from tessera.llm.quality import FEATURES, fit, fold, statistics, train, with_score

from .fixtures import components, documents, empty, prose, shingle_set

# --- mixing


def brute_targets(sizes, weights, share, most):
    """The same law by single steps: cap one source at a time."""
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weights[s] for s in sizes if s not in capped)
        over = [s for s in sizes if s not in capped and left * weights[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in capped else left * weights[s] / total for s in sizes}
        capped.add(over[0])


def test_targets_share_until_none_is_above():
    rng = random.Random(0)
    for _ in range(200):
        sizes = {f"s{i}": rng.randrange(0, 1000) for i in range(rng.randint(1, 9))}
        weights = dict(zip(sizes, cycle([3, 1, 2])(list(sizes))))
        got, want = source_targets(sizes, weights, 1.5, 2), brute_targets(sizes, weights, 1.5, 2)
        assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_flow_repeats_only_when_it_must():
    flows = route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 60}, 2)
    assert sum(flows[p].get("a", 0) for p in flows) == 120 and sum(flows[p].get("b", 0) for p in flows) == 60
    repeated = sum(max(0, sum(f.values()) - n) for (p, f), n in zip(flows.items(), (100, 50, 10)))
    assert repeated == 20  # 180 words are wanted and there are 160
    net = Flow()
    net.edge("start", "x", 5, 3)
    net.edge("start", "y", 5, 1)
    e = [net.edge("x", "end", 5, 0), net.edge("y", "end", 4, 0)]
    net.run("start", "end")
    assert [net.cap[i ^ 1] for i in e] == [5, 4]


def test_mix_meets_its_targets(spark):
    docs = documents(spark, 200)
    rows = mix(docs, F.array("source"), cycle([3, 1, 2]), 1.5, 2).collect()
    size = {(r["doc_id"], r["text"]): len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[tuple(r["sources"])].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(by, key=lambda s: (s[0] is None, s[0] or ""))
    sizes = {s: sum(r["size"] for r in by[s]) for s in names}
    want = brute_targets(sizes, dict(zip(names, cycle([3, 1, 2])(names))), 1.5, 2)
    for s in names:
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= 1
    again = mix(docs.repartition(3), F.array("source"), cycle([3, 1, 2]), 1.5, 2).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in again) and size


def test_mix_of_overlapping_sources_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 5 else ["a", "b"]) for i in range(10)], "doc_id long, text string, m array<string>")
    rows = mix(docs, F.col("m"), lambda names: [1] * len(names), 1.0, 2).collect()
    assert sum(r["taken"] for r in rows) == 100
    assert mix(empty(spark), F.array("source"), cycle([1]), 1.5, 2).count() == 0
    none = spark.createDataFrame([(1, None, "x"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(none, F.array("source"), cycle([1]), 1.5, 2).collect()] == [0, 0]


# --- quality


def junk(rng, kind, n=60):
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["$$$", "&&&", "###"]) for w in words)
    if kind == 2:
        return " ".join([words[0]] * n)
    return " | ".join(words)


def labelled(spark, n=400, seed=0):
    rng = random.Random(seed)
    rows = [(i, junk(rng, i % 4, rng.randrange(5, 90)) if i % 5 == 0 else prose(rng, rng.randrange(5, 120)) + ".", int(i % 5 != 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_statistics_are_finite_for_any_text():
    for text in (b"", b" ", b"\n\n", b"a", b"\x00\xff", "é日".encode(), b"w " * 100_000, b"x" * 300_000):
        s = statistics(text)
        assert len(s) == len(FEATURES) and np.isfinite(s).all()


def test_flattened_trees_like_a_walk_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0)).astype(float)
    forest = fit(x, y, trees=100, depth=3)  # three features decide together, which twenty small trees can't fit
    for row in x[:40]:
        total = forest.base
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        assert forest.raw(row[None])[0] == pytest.approx(total)
    assert ((forest.score(x) >= 0.5) == (y > 0.5)).mean() > 0.9


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 1] > 0.2) & (x[:, 3] > -0.4)).astype(float)
    p = 1 / (1 + np.exp(-np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    g, h = p - y, np.full(len(y), p * (1 - p))
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
    cuts = [(f, t) for f in range(4) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 64)[1:-1]))]
    best = max(cuts, key=lambda c: worth(x[:, c[0]] <= c[1]) + worth(x[:, c[0]] > c[1]))
    forest = fit(x, y, trees=1, depth=1)
    assert (forest.feature[0][0], forest.limit[0][0]) == best


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    scored = with_score(docs, train(docs, labels)).join(labels, "doc_id").select("score", "quality", (fold() == 1).alias("held")).collect()
    held = [r for r in scored if r["held"]]
    assert len(held) > 80 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.95


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = labelled(spark, 150)
    flipped = labels.withColumn("quality", F.when(fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train(docs, labels), train(docs, flipped)
    assert (a.leaf == b.leaf).all() and (a.limit == b.limit).all()


def test_quality_edge_tables(spark):
    docs, labels = labelled(spark, 30)
    forest = train(docs, empty(spark, labels.schema))
    assert {r["score"] for r in with_score(docs, forest).collect()} == {0.5}
    dirty = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, None)], labels.schema)).unionByName(labels.limit(3))
    odd = documents(spark, 10)
    rows = with_score(odd, train(docs, dirty)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert with_score(empty(spark), forest).count() == 0
    assert train(docs, labels, rows=20).leaf.shape[1] == 16


# --- the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Quality prose with planted copies, near copies and junk, and labels of most."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark, 240, seed=5)
    rng = random.Random(6)
    rows = [tuple(r) for r in docs.collect()]
    base = [r for r in rows if r[0] % 5 == 1 and len(r[1].split()) > 60][:12]
    extra = []
    for k, r in enumerate(base):
        extra.append((1000 + k, r[1], "en", "src0", r[4]))
        words = r[1].split()
        words[rng.randrange(10, 50)] = "different"
        extra.append((2000 + k, " ".join(words), "en", "src1", r[4]))
    extra += [(3000, None, None, None, None), (3001, "", "en", "src1", 0), (None, prose(rng, 80) + ".", "en", "src2", 9), (None, base[0][1], "en", "src2", 9), rows[1]]
    table = spark.createDataFrame(rows + extra, docs.schema).withColumns({"_key": F.lit("mine"), "size": F.lit(3), "score": F.lit(0.1)})
    table.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, folder).cache()
    assert good.columns == docs.columns and {r["_key"] for r in good.select("_key").distinct().collect()} == {"mine"}
    kept = {r["doc_id"] for r in good.collect()}
    assert len([i for i in range(240) if i % 5 and i not in kept]) <= 4 and len([i for i in range(0, 240, 5) if i in kept]) <= 4
    single = corpus_pipeline.near_dedup(spark, good, folder).cache()
    rows, left = good.collect(), single.collect()
    sets = [shingle_set(r["text"]) for r in rows]
    root = components(len(rows), ((i, j) for i in range(len(rows)) for j in range(i) if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))
    assert len(left) == len(set(root)) and single.columns == docs.columns
    want = Counter(min(str(rows[j]["doc_id"]) if rows[j]["doc_id"] is None else f"{rows[j]['doc_id']:09}" for j in range(len(rows)) if root[j] == k) for k in set(root))
    assert want == Counter("None" if r["doc_id"] is None else f"{r['doc_id']:09}" for r in left)
    mixed = corpus_pipeline.mix_sources(spark, single, folder).collect()
    times = Counter((r["doc_id"], r["text"]) for r in mixed)
    assert max(times.values()) <= 2 and set(times) <= {(r["doc_id"], r["text"]) for r in left}
    words = lambda rs: sum(len((r["text"] or "").split()) for r in rs)
    assert abs(words(mixed) - 1.5 * words(left)) <= 4 * 120


def test_run_packs_what_the_stages_keep(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 1024 for r in used)


def test_stages_take_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
