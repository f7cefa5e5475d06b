import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.ann import Graph, centres, nearest, probed_cells
from tessera.llm.common import partition_keys
from tessera.llm.embed_dedup import Cells, block_size, linked_vectors, receives

from .fixtures import components, unit, vector_rows, vectors


def brute_links(rows, dim, least):
    ids, x = unit(rows, dim)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    root = components(len(ids), zip(*np.nonzero(np.triu(hit))))
    out = {r[0]: (0, r[0], True) for r in rows}
    for i, v in enumerate(ids):
        out[v] = (int(hit[i].sum()), ids[root[i]], root[i] == i)
    return out


@pytest.mark.parametrize("options", [{}, {"block": 20, "sample": 60}, {"block": 16, "sample": 30, "dense": 1000}, {"dense": 2, "block": 10}])
@pytest.mark.parametrize("dim", [3, 8])
def test_links_and_components_like_brute_force(spark, dim, options):
    rows = vector_rows(np.random.default_rng(dim), 120, dim)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(vectors(spark, rows), 0.95, **options).collect()}
    assert got == brute_links(rows, dim, 0.95)


def test_chain_is_one_component(spark):
    angle = np.arange(60) * 0.2
    rows = [(i, [float(np.cos(a)), float(np.sin(a)), 0.0], 0, 0, 0, 0.0) for i, a in enumerate(angle[:14])]
    got = linked_vectors(vectors(spark, rows), 0.95, block=4, sample=10).collect()
    assert {r["component_id"] for r in got} == {0} and [r["n_links"] for r in sorted(got, key=lambda r: r["vec_id"])] == [1] + [2] * 12 + [1]


def test_embeddings_edge_tables(spark):
    assert linked_vectors(vectors(spark, []), 0.95).count() == 0
    assert [tuple(r) for r in linked_vectors(vectors(spark, [(4, None, 0, 0, 0, 0.0)]), 0.95).collect()] == [(4, 0, 4, True)]
    row = (7, [1.0, 0.0], 0, 0, 0, 0.0)
    assert {tuple(r) for r in linked_vectors(vectors(spark, [row, row]), 0.95).collect()} == {(7, 1, 7, True)}
    none = [(None, [1.0, 0.0], 0, 0, 0, 0.0), (3, [1.0, 0.0], 0, 0, 0, 0.0)]
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in linked_vectors(vectors(spark, none), 0.95).collect()} == {(None, 1, 3), (3, 1, 3)}
    assert nearest(vectors(spark, []), vectors(spark, []), 5).count() == 0


def brute_nearest(rows, dim, k, asked):
    ids, x = unit(rows, dim)
    out = {}
    for q in asked:
        if q in ids:
            s = x @ x[ids.index(q)]
            out[q] = sorted((-round(float(v), 12), i) for v, i in zip(s, ids) if i != q)[:k]
    return out


@pytest.mark.parametrize("shard", [30, 4096])
def test_nearest_like_brute_force(spark, shard):
    rows = vector_rows(np.random.default_rng(5), 150)
    df = vectors(spark, rows)
    got = {}
    for r in nearest(df, df.filter("vec_id % 10 = 0"), 5, shard=shard).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_nearest(rows, 8, 5, [i for i, *_ in rows if i % 10 == 0])
    assert got.keys() == want.keys()
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))
    assert found >= 0.98


def test_copies_come_by_smaller_id_and_few_candidates_are_all_returned(spark):
    rows = [(i, [1.0, 1.0], 0, 0, 0, 0.0) for i in range(30)] + [(40, [1.0, 0.0], 0, 0, 0, 0.0)]
    df = vectors(spark, rows)
    got = nearest(df, df.filter("vec_id IN (3, 40)"), 5).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 4, 5, 0, 1, 2, 3, 4]
    two = vectors(spark, rows[29:])
    assert nearest(two, two, 5).count() == 2


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:100]
    found, sims = Graph(x).search(q, 120)
    want = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(f[:6]) & set(w)) / 6 for f, w in zip(found, want)]) > 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def test_graph_insertion_by_search_alone():
    """Without a scan beyond the first vectors, batches find their neighbours in the graph so far."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x, scan=64)
    found, _ = graph.search(x[:100], 120)
    want = np.argsort(-(x[:100] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(f[:6].tolist()) & set(w.tolist())) / 6 for f, w in zip(found, want)]) > 0.95
    assert sorted(graph.order.tolist()) == list(range(2500)) and all(len(a) >= len(b) for a, b in zip(graph.layers, graph.layers[1:]))
    assert all(links.max(initial=-1) < len(links) for links in graph.layers)


def test_queries_go_to_as_few_cells_as_hold_their_neighbours(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 8)) * 10
    rows = [(i, list(map(float, middle[i % 12] + rng.normal(size=8))), 0, 0, 0, 0.0) for i in range(600)]
    df = vectors(spark, rows)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = df.selectExpr("array(vec_id) as ids", "embedding as v")
    asked = df.filter("vec_id % 7 = 0").selectExpr("vec_id as id", "embedding as v")
    assert probed_cells(units, asked, centres(x, 12), 8, 5) <= 4
    noise = rng.normal(size=(12, 8))
    assert probed_cells(units, asked, noise / np.linalg.norm(noise, axis=1, keepdims=True), 8, 5, held=1.0) >= 1
    got = nearest(df, df.filter("vec_id % 7 = 0"), 5, shard=50).collect()
    want = brute_nearest(rows, 8, 5, [i for i in range(0, 600, 7)])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & {i for _, i in want[q]}) / 5 for q in want]) >= 0.95


def test_each_pair_of_cells_is_compared_once_and_copies_grow_with_the_root():
    for a in range(9):
        for b in range(9):
            assert (int(receives(a, b)) + int(receives(b, a))) == (a != b)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = {}
    for total in (10_000, 400_000):
        cells = Cells(np.zeros((0, 64)), x[: -(-total // block_size(total))], 0.3162)
        copies[total] = 1 + len(cells.of(x)[1]) / len(x)
    assert copies[400_000] / copies[10_000] < 40**0.5


def test_keys_go_to_the_partitions_meant(spark):
    for n in (1, 5, 12):
        df = spark.createDataFrame([(k, p) for p, k in enumerate(partition_keys(n))], "key int, p int").repartition(n, "key")
        assert all(r["p"] == r["at"] for r in df.select("p", F.spark_partition_id().alias("at")).collect())
