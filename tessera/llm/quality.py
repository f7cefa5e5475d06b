"""Quality scores: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts on the executors; training takes a bounded sample of labelled rows to the
driver, as numbers only.  Trees are complete and flattened into arrays, so a batch walks all trees in numpy.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, utf8

#: The most labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_bytes_spread", "letters", "capitals", "digits", "spaces", "line_breaks",
    "sentence_marks", "commas", "loud_marks", "bars", "signs", "brackets", "quotes", "wide_bytes", "controls",
    "repeated_next", "longest_run", "distinct_words", "top_word", "distinct_lines", "short_lines", "distinct_bytes", "words_a_mark",
)

_CLASSES = np.zeros((256, 13), dtype=np.float64)
for _i, _chars in enumerate(
    (
        bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"#$%&*@^~+=<>_\\/", b"()[]{}", b"\"'`",
        bytes(range(128, 256)),
    )
):
    _CLASSES[list(_chars), _i] = 1
_CONTROLS = [b for b in range(32) if b not in (9, 10, 13)] + [127]


def statistics(text: bytes) -> list[float]:
    """One number per name in :data:`FEATURES`; all defined for an empty text."""
    n = len(text)
    bytes_ = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    letters, capitals, digits, spaces, breaks, stops, commas, loud, bars, signs, brackets, quotes, wide = (bytes_ @ _CLASSES).tolist()
    words = text.split()
    count = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    same = list(map(operator.eq, words, words[1:]))
    run = 1 + max((sum(1 for _ in g) for equal, g in groupby(same) if equal), default=0) if any(same) else min(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    size, w, rows = max(1, n), max(1, len(words)), max(1, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0,
        letters / size, capitals / max(1.0, letters), digits / size, spaces / size, breaks / size,
        stops / w, commas / w, loud / w, bars / w, signs / w, brackets / w, quotes / w, wide / size, float(bytes_[_CONTROLS].sum()) / size,
        sum(same) / w, np.log1p(run), len(count) / w, count.most_common(1)[0][1] / w if words else 0.0, len(set(lines)) / rows, sum(len(x) < 30 for x in lines) / rows,
        float(np.count_nonzero(bytes_)), w / (1 + stops),
    ]


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``limit`` hold the inner nodes of each complete tree, level by level; ``leaf`` its leaves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = (self.leaf.shape[1]).bit_length() - 1 if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, weight: float = 2.0, least: float = 5.0) -> Forest:
    """Gradient boosting on the logistic loss; splits are searched on histograms over quantile bins.

    ``weight`` shrinks leaves, ``least`` is the sum of second derivatives a child needs.  Without rows of both labels
    the forest has no tree and scores their smoothed share.
    """
    n, width = x.shape
    positive = float(y.sum())
    base = float(np.log((positive + 1) / (n - positive + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    if not 0 < positive < n:
        return Forest(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * bins
    raw = np.full(n, base)
    out: tuple[list, list, list] = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first) * (width * bins))[:, None] + flat
            sums = [np.bincount(at.ravel(), np.repeat(v, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + weight) + (gt - gl) ** 2 / (ht - hl + weight) - gt**2 / (ht + weight)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            cut = np.full(many, bins)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], limit[first + k], cut[k] = f, edges[f][b], b
            k = node - first
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[k])
        place = node - inner
        leaf = -rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + weight)
        raw += leaf[place]
        for column, value in zip(out, (feature, limit, leaf)):
            column.append(value)
    return Forest(base, *(np.array(v) for v in out))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; 1 is held out.  A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def _table(texts: pa.Array) -> np.ndarray:
    """Statistics row by row; few texts are decoded at a time."""
    rows = [statistics(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
    give_back()
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


def _statistics(text: pa.Array) -> pa.Array:
    return pa.array(_table(text).tolist(), pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, drawn by a hash of their id.

    Labels without an id or value are ignored; ids that occur more than once on either side give a row for each pair, of
    which at most ``2 * rows`` are taken, smallest ids first.  The drawn ids (at most ``rows``) are broadcast to the documents; only
    their statistics and labels reach the driver.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(id_col) != 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("double").alias("y"))
    n = usable.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    if n > rows:  # a threshold first, so that no task orders more than about the rows wanted
        usable = usable.filter(draw < int((1 << 30) * min(1.0, 1.2 * rows / n)))
    drawn = usable.orderBy(draw, "id", "y").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    found = texts.join(F.broadcast(drawn), "id").select("id", "y", F.arrow_udf(_statistics, "array<double>")("text").alias("x")).orderBy("id", "y", "x").limit(2 * rows).toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(found.column("x").to_pylist()), np.array(found.column("y").to_pylist()))


def with_score(docs: DataFrame, forest: Forest, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability that a text is of quality; only the text column reaches Python.

    Null and empty texts are scored by the statistics of an empty text, very long ones by those of the whole text; rows are
    kept as they are, repeated ones and null ids included; an empty table gives no rows; a column of that name is replaced.
    """

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(forest.score(_table(text)), pa.float64())

    return docs.withColumn(name, score(utf8(text_col)))
