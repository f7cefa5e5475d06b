"""Documents with every awkward case, and brute-force versions of the operators."""

import random

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, node long, score double, f0 long, rank int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def documents(spark, n=120, seed=1, nulls=True):
    """Prose, copies, near copies, null and empty texts, a very long text, repeated rows, a hot source, clashing columns."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(1, 200))
        if i % 10 == 3:
            text = rows[-1][1]  # an exact copy
        if i % 10 == 5:
            words = rows[-1][1].split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        source = "hot" if i % 3 else f"src{i % 7}"
        rows.append((i, text, "en", source, len(text), 7, 1, 2, 0.5, 3, 4))
    if nulls:
        rows += [
            (n, None, None, None, None, None, None, None, None, None, None),
            (n + 1, "", "en", "src1", 0, 1, 1, 1, 0.1, 1, 1),
            (None, "a text without id", "en", "hot", 5, 1, 1, 1, 0.1, 1, 1),
            (n + 2, prose(rng, 30_000), "en", "long", 9, 1, 1, 1, 0.1, 1, 1),
            (n + 3, "  \n\t ", "en", "", 5, 1, 1, 1, 0.1, 1, 1),
            rows[0],
        ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def components(n, linked):
    """Smallest index reachable of each of n items."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else {()}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, n long, score double")


def vector_rows(rng, n, dim=8, clique=40):
    """Random vectors, a tight group, equal ones, and unusable ones."""
    x = [list(map(float, v)) for v in rng.normal(size=(n, dim))]
    centre = rng.normal(size=dim)
    x += [list(map(float, centre + rng.normal(size=dim) * 0.03)) for _ in range(clique)]
    x += [x[0], x[0], [2 * v for v in x[1]]]
    rows = [(i, v, i % 3, 1, 1, 0.5) for i, v in enumerate(x)]
    m = len(rows)
    return rows + [(m, None, 0, 1, 1, 0.1), (m + 1, [0.0] * dim, 0, 1, 1, 0.1), (m + 2, [None] + [1.0] * (dim - 1), 0, 1, 1, 0.1), (m + 3, [float("nan")] + [1.0] * (dim - 1), 0, 1, 1, 0.1), (m + 4, [float("inf")] + [1.0] * (dim - 1), 0, 1, 1, 0.1), (m + 5, [1.0], 0, 1, 1, 0.1)]


def unit(rows, dim=8):
    """Usable ids and their unit vectors."""
    good = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([np.array(v, dtype=np.float32) for _, v in good], dtype=np.float64)
    return [i for i, _ in good], x / np.linalg.norm(x, axis=1, keepdims=True)
