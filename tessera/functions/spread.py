"""Numbers that hash partitioning deals to a partition each, for few heavy groups."""

from __future__ import annotations

from functools import lru_cache


def spark_hash(i: int) -> int:
    """Spark's hash of an integer column (Murmur3 with seed 42), by which it deals rows to partitions."""
    word = 0xFFFFFFFF
    k = i * 0xCC9E2D51 & word
    h = 42 ^ ((k << 15 | k >> 17) & word) * 0x1B873593 & word
    h = ((h << 13 | h >> 19) & word) * 5 + 0xE6546B64 & word
    h ^= 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & word
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@lru_cache(maxsize=64)
def partition_keys(n: int) -> tuple[int, ...]:
    """One number for each of n partitions that hash partitioning deals there, so that n heavy groups get a task each."""
    out: dict[int, int] = {}
    i = 0
    while len(out) < n:
        out.setdefault(spark_hash(i) % n, i)
        i += 1
    return tuple(out[p] for p in range(n))
