"""Hard negatives against a plain loop: ties, blocks of every shape, several panels, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score double, block string, seen int"


def brute(rows, positives=5, negatives=3):
    """Every row's score with every anchor, in Python's integers."""
    use = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label, *_ in rows
           if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, v in use:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in use)
        best = [(-s, j) for s, j, other in scored if other == label and j != i][:positives]
        for score, j in best:
            found = [(-s, k) for s, k, other in scored if other != label and 50 * score <= -100 * s <= 95 * score]
            out += [(i, j, rank, k, score, s) for rank, (s, k) in enumerate(found[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 50 == 0, label=label, **sizes).collect()))


def table(n=420, dim=11, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    rows = []
    for i in range(n):
        label = 4 if i % 3 == 0 else int(rng.integers(10))  # a hot label
        v = centres[label] * 0.5 + rng.normal(size=dim)
        rows.append([i, [float(np.float32(x)) for x in np.round(v, 1)], label])
    for i in range(60, 90):
        rows[i][1] = rows[60][1]  # ties
    return [(*r, 1, 0.5, "b", 2) for r in rows]


AWKWARD = [(None, [1.0] * 11, 3), (1000, None, 3), (1050, [1.0] * 10 + [None], 3), (1100, [float("nan")] + [1.0] * 10, 3), (1150, [float("inf")] + [1.0] * 10, 3),
           (1200, [1.0] * 11, None), (1250, [], 3), (1300, [2.0, 1.0], 3), (1301, [0.0] * 11, 5), (1302, [3.0] * 14, 5)]


@pytest.mark.parametrize("sizes", [{}, {"block": 50, "width": 3, "dims": 4}, {"block": 64, "width": 2, "dims": 1, "panel": 3}])
def test_equals_brute_force(spark, sizes):
    rows = table() + [(*r, 1, 0.5, "b", 2) for r in AWKWARD]
    got = mined(spark, rows, **sizes)
    assert got == brute(rows)
    assert got and len({g[0] for g in got}) > 5


def test_many_small_labels_share_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)], int(i % 97), 1, 0.5, "b", 2) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 50 == 0, block=40, width=2, dims=4).collect()))
    plain = [(r[0], r[1], r[2]) for r in rows]
    want = []
    for i, v, label in plain:
        if i % 50 == 0:
            q = [[int(np.floor(256 * float(np.float32(x)))) for x in w] for _, w, _ in plain]
            s = {j: sum(a * b for a, b in zip(q[i], q[j])) for j in range(400)}
            for j in sorted((j for j in s if plain[j][2] == label and j != i), key=lambda j: (-s[j], j))[:5]:
                able = sorted((k for k in s if plain[k][2] != label and 50 * s[j] <= 100 * s[k] <= 95 * s[j]), key=lambda k: (-s[k], k))
                want += [(i, j, rank, k, s[j], s[k]) for rank, k in enumerate(able[:3], 1)]
    assert got == sorted(want)


def test_repeated_and_empty_rows(spark):
    rows = table(120)
    twice = rows + rows[10:12]
    got = mined(spark, twice)
    assert {g[0] for g in got} <= {0, 50, 100}
    assert all(a != b for a, b, *_ in got)
    assert mined(spark, []) == []
    assert mined(spark, [r for r in rows if r[0] % 50]) == []


def test_products_are_exact_beyond_floating_point():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**40), 2**40, (5, 3)), rng.integers(-(2**20), 2**20, (4, 3))
    assert (H.product(a, b) == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]).all()
    tile = rng.integers(np.iinfo(np.int64).min, np.iinfo(np.int64).max, (7, 9))
    assert (H.unsqueeze(H.squeeze(tile), tile.shape) == tile).all()
