"""Readers and writers of tables, sheets and logs."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; what is written there goes when the application ends."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once and lost executors reread it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV with a header (a byte-order mark is fine); all columns are texts without a schema.  Types are never inferred."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    """The table, or an empty one if it is not there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).format(kind).load(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to a log; earlier rows are never touched."""
    df.write.mode("append").json(path)


def write_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV with exactly these columns: others are left out, missing and null ones are empty."""
    have = set(df.columns)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns]
    df.select(cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_with_backup(df: DataFrame, path: str) -> str | None:
    """Replace a table; the one before is moved to ``<path>.backups/<time>``, which is returned.

    The new table is whole before the old one moves.  If it can't take the place, the old one returns; if the driver ends in
    between, :func:`current_table` finds the backup.
    """
    spark = df.sparkSession
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    fresh = f"{path}.new-{stamp}"
    df.write.parquet(fresh)
    fs, target = _hadoop(spark, path)
    backup, to = None, None
    if fs.exists(target):
        backup = f"{path}.backups/{stamp}"
        _, to = _hadoop(spark, backup)
        fs.mkdirs(to.getParent())
        if not fs.rename(target, to):
            raise OSError(f"{path} can't be moved to {backup}")
    if not fs.rename(_hadoop(spark, fresh)[1], target):
        if to is not None:
            fs.rename(to, target)
        raise OSError(f"{fresh} can't be moved to {path}")
    return backup


def current_table(spark: SparkSession, path: str) -> str:
    """Where a table of :func:`write_with_backup` is: its place, or its newest backup if a replacement was cut off."""
    fs, target = _hadoop(spark, path)
    _, folder = _hadoop(spark, f"{path}.backups")
    if fs.exists(target) or not fs.exists(folder):
        return path
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return f"{path}.backups/{max(names)}" if names else path


def add_column_if_missing(df: DataFrame, name: str, kind: str, default) -> DataFrame:
    """Additive schema change: old rows get the default."""
    value = F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    return df.withColumn(name, value.cast(kind))


def file_hashes(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of each file's bytes, computed where the files are."""
    rows = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("hash")).collect()
    return {os.path.basename(r["path"]): r["hash"] for r in rows}


def canonical_hash(config: dict) -> str:
    """SHA-256 of a configuration, independent of the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def write_pointer(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file in the shared folder that is replaced at once: written aside, then moved over the one before."""
    fs, target = _hadoop(spark, path)
    _, fresh = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), options)


def read_pointer(spark: SparkSession, path: str) -> dict:
    """The pointer, or an empty one if it is missing or broken."""
    if not exists(spark, path):
        return {}
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (TypeError, ValueError):
        return {}


def load_sources(spark: SparkSession, units: str, labels: str, rows: str, schemas: dict[str, T.StructType]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units (CSV), labels (JSON lines) and rows (CSV), each with its schema of that name."""
    return read_csv(spark, units, schemas["units"]), read_jsonl(spark, labels, schemas["labels"]), read_csv(spark, rows, schemas["rows"])


def read_queries(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The evaluation's queries, all texts, of one ``split`` if given."""
    rows = read_csv(spark, path)
    return rows if split is None else rows.filter(F.col("split") == split)
