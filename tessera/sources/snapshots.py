"""Versioned tables: a reader stays on the version that it opened while the next one is written and swapped in.

A version is a small manifest, numbered and never changed.  The next one is made by creating its file, which fails if someone
else made it first, so a swap is a compare-and-set; what a manifest lists is in place before.  Readers leave a mark on their
version, and versions that are neither current nor marked can be removed with what only they list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import _hadoop


class Conflict(RuntimeError):
    """Someone else swapped in a version first."""


class Manifests:
    """Numbered manifests under ``root``, from 1 on; version 0 is the empty one before any."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, path = _hadoop(spark, self.root)
        for part in ("versions", "readers"):
            self.fs.mkdirs(_hadoop(spark, f"{self.root}/{part}")[1])

    def _names(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(_hadoop(self.spark, f"{self.root}/{part}")[1]))

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("versions") if n.isdigit()]

    def current(self) -> int:
        return max(self.versions(), default=0)

    def value(self, version: int) -> dict:
        if not version:
            return {}
        stream = self.fs.open(_hadoop(self.spark, f"{self.root}/versions/{version:012d}")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, expected: int, value: dict) -> int:
        """Make ``value`` the version after ``expected``; :class:`Conflict` if that is not the current one any more."""
        if self.current() != expected:
            raise Conflict(f"version {self.current()} is current, not {expected}")
        # Written aside and then linked in: a manifest is there whole or not at all, and an existing one is never replaced.
        aside = _hadoop(self.spark, f"{self.root}/.{uuid.uuid4().hex}")[1]
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        out.close()
        target = _hadoop(self.spark, f"{self.root}/versions/{expected + 1:012d}")[1]
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(target), none)
        except Exception as e:
            self.fs.delete(aside, False)
            raise Conflict(f"version {expected + 1} was made by someone else") from e
        return expected + 1

    def pin(self, version: int) -> str:
        """A reader's mark on a version, to be given to :meth:`unpin`."""
        mark = f"{version:012d}.{uuid.uuid4().hex}"
        self.fs.create(_hadoop(self.spark, f"{self.root}/readers/{mark}")[1], False).close()
        return mark

    def unpin(self, mark: str) -> None:
        self.fs.delete(_hadoop(self.spark, f"{self.root}/readers/{mark}")[1], False)

    def expire(self, paths: Callable[[dict], set[str]]) -> list[int]:
        """Remove versions that are neither current nor read, and the ``paths`` that only they list."""
        read = {int(m.split(".")[0]) for m in self._names("readers") if m[0].isdigit()}
        there = self.versions()
        gone = [v for v in there if v != max(there) and v not in read]
        kept = set().union(*(paths(self.value(v)) for v in there if v not in gone)) if there else set()
        for v in gone:
            # The manifest goes first: what is left of an interrupted removal is listed nowhere and read by nobody.
            listed = paths(self.value(v))
            self.fs.delete(_hadoop(self.spark, f"{self.root}/versions/{v:012d}")[1], False)
            for path in listed - kept:
                self.fs.delete(_hadoop(self.spark, path)[1], True)
        return gone


class Reader:
    """A version opened for reading; use it in a ``with`` block, or call :meth:`close`."""

    def __init__(self, manifests: Manifests, version: int, df: DataFrame):
        self.version, self.df, self._manifests = version, df, manifests
        self._mark = manifests.pin(version)

    def close(self) -> None:
        if self._mark:
            self._manifests.unpin(self._mark)
            self._mark = None

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class SnapshotTable:
    """A table that is replaced as a whole, such as an index's vectors after retraining."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.manifests = spark, Manifests(spark, root)

    def write(self, df: DataFrame, expected: int | None = None, **notes) -> int:
        """Swap in ``df`` after the version ``expected`` (by default the current one); returns the new version.

        The data is written before the swap, under a name of its own, so a failed or beaten writer leaves the table as it is.
        """
        expected = self.manifests.current() if expected is None else expected
        path = f"{self.manifests.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        try:
            return self.manifests.commit(expected, {"path": path, "schema": df.schema.json(), "notes": notes})
        except Conflict:
            self.manifests.fs.delete(_hadoop(self.spark, path)[1], True)
            raise

    def open(self, version: int | None = None) -> Reader:
        """The current version, or an older one that is still there."""
        version = self.manifests.current() if version is None else version
        if version not in self.manifests.versions():
            raise KeyError(f"there is no version {version}")
        value = self.manifests.value(version)
        schema = T.StructType.fromJson(json.loads(value["schema"]))
        return Reader(self.manifests, version, self.spark.read.schema(schema).parquet(value["path"]))

    def expire(self) -> list[int]:
        return self.manifests.expire(lambda v: {v["path"]})


class KeyedTable:
    """A table of one row a key in hash buckets; an upsert rewrites only the buckets that it touches.

    Keys are dealt by a hash, so a bucket holds about 1/``buckets`` of the keys whatever they are.  A manifest maps each bucket to
    its folder and names the last batch, which makes a replayed batch a no-op.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.manifests = Manifests(spark, root)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _load(self, value: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f"{p}/bucket={b}" for b, p in value.get("folders", {}).items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._load(self.manifests.value(self.manifests.current()))

    def upsert(self, rows: DataFrame, batch: int) -> list[int]:
        """Put ``rows``, one a key, in place of those with their keys; returns the buckets rewritten.

        What is brought to the driver is the list of touched buckets, at most ``buckets`` numbers.
        """
        version = self.manifests.current()
        value = self.manifests.value(version)
        if batch <= value.get("batch", -1):
            return []
        rows = rows.select(*self.schema.names).persist()
        try:
            touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())
            if touched:
                old = self._load(value, touched)
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
                kept = old.alias("o").join(rows.alias("n"), same, "left_anti")
                fresh = f"{self.manifests.root}/data/{uuid.uuid4().hex}"
                merged = kept.unionByName(rows).withColumn("bucket", self._bucket())
                merged.repartition(min(len(touched), 4096), "bucket").write.partitionBy("bucket").parquet(fresh)
                value = {**value, "folders": {**value.get("folders", {}), **{str(b): fresh for b in touched}}}
            self.manifests.commit(version, {**value, "batch": batch})
            return touched
        finally:
            rows.unpersist()

    def expire(self) -> list[int]:
        """Remove old versions; a batch's folder goes when no bucket of a kept version lies in it any more."""
        return self.manifests.expire(lambda v: set(v.get("folders", {}).values()))
