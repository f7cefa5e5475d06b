"""Scratch tables in the shared folder, batch helpers and text encodings used by several operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder to cut lineage; lost executors reread them instead of recomputing.

    The folder goes when the application ends, as results may read its tables until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        files, path = self._files(self.root)
        files.deleteOnExit(path)
        self._n = 0

    def _files(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table written by :meth:`save` that nothing reads any more."""
        files, path = self._files(df._scratch_path)
        files.delete(path, True)


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


#: A key is hot if it has more than this share of the rows, or more rows than one task should hold, whatever the input; the
#: largest so many are dealt with as such.
HOT, HELD, MOST_HOT = 1 / 256, 1_000_000, 4096
#: Tasks that a hot key's rows are spread over.
SALTS = 64


def hot_from(total: int, least: int, sampled: int = 1) -> int:
    """The number of rows from which a key is hot among ``total`` (both counted in one row of ``sampled``)."""
    return max(least, min(int(total * HOT), HELD // sampled))


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, hot: list, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (one row a key) on ``key``; rows of the ``hot`` keys are dealt to :data:`SALTS` tasks by a
    hash of ``by``, to which the one row goes as often."""
    if not hot:
        return many.join(one, key, how)
    # Salts only part the tasks: every row of ``many`` meets its key's row exactly once.
    is_hot = F.col(key).isin(*hot)
    left = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0))
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    right = right.withColumn("_salt", F.col("_salt").cast("long"))
    return left.withColumn("_salt", F.col("_salt").cast("long")).join(right, [key, "_salt"], how).drop("_salt")


#: Bits of the map that :func:`maybe_among` sends to the tasks: at most 2**18 rows of two numbers, whatever the input.
SLOTS = 1 << 24


def maybe_among(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false only where ``key`` is surely none of the ``ids`` (a column of that name).

    What is sent to the tasks is a map of hashed ids of fixed size.  Rows it rules out need no shuffle; with very many ids
    it rules out fewer, which costs time and changes no result, as a join decides about the rest.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    words = ids.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = df.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(words), "_word", "left")
    return out.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_slot", "_word", "_bits")


def _spark_hash(i: int) -> int:
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


def partition_keys(n: int) -> list[int]:
    """One number for each of n partitions that hash partitioning deals there, so that n heavy groups get a task each."""
    out: dict[int, int] = {}
    i = 0
    while len(out) < n:
        out.setdefault(_spark_hash(i) % n, i)
        i += 1
    return [out[p] for p in range(n)]


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The same batches in slices of at most ``chunk`` rows, so that a worker holds few decoded texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            yield batch.slice(at, chunk)
        del batch
        give_back()
