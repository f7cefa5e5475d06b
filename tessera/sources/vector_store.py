"""Vector tables with a manifest: written once per configuration, checked on every read."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vector import vector_stats
from tessera.sources.tables import _hadoop, canonical_hash, exists

VERSION = 1


@dataclass(frozen=True)
class ModelSpec:
    """What an encoder must agree on with stored vectors."""

    model_id: str
    model_revision: str
    dimension: int
    normalized: bool = True
    pooling: str = "mean"
    max_seq_length: int = 512
    query_prefix: str = "query: "
    document_prefix: str = "passage: "
    text_spec_version: int = 1

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def slug(self) -> str:
        """The model's name as a part of a folder's name."""
        return re.sub(r"[^a-z0-9]+", "-", self.model_id.rsplit("/", 1)[-1].lower()).strip("-")


def store_config(spec: ModelSpec, variant: str, source_files: dict[str, str], text_field: str = "embedding_text") -> dict:
    """The configuration that a table of vectors is stored under: the encoder, the text variant and the sources' hashes."""
    return spec.as_dict() | {"text_variant": variant, "text_field": text_field, "source_files": dict(sorted(source_files.items()))}


def result_name(spec: ModelSpec, variant: str, config: dict) -> str:
    """A table's name: model, revision, variant and the beginning of its configuration's hash."""
    return f"{spec.slug}_{spec.model_revision[:8]}_{variant}_{canonical_hash(config)[:10]}"


def incompatible(manifest: dict, spec: ModelSpec, source_files: dict[str, str]) -> list[str]:
    """What in a stored table disagrees with the encoder or the sources' hashes; empty if it may be used."""
    config = manifest.get("config") or {}
    said = {k: config.get(k) for k in spec.as_dict()}
    out = [f"{k}: stored {said[k]!r}, expected {v!r}" for k, v in spec.as_dict().items() if said[k] != v]
    kept = config.get("source_files") or {}
    return out + [f"{name} has changed" for name, digest in sorted(source_files.items()) if kept.get(name) != digest]


def provenance(manifest: dict) -> dict:
    """Where vectors come from, as it is kept with what was made of them."""
    config = manifest.get("config") or {}
    parts = {k: config.get(k) for k in ("model_id", "model_revision", "text_variant", "text_spec_version", "source_files")}
    return {k: manifest.get(k) for k in ("name", "config_hash", "num_vectors", "dimension", "created_at")} | parts


class StoreError(ValueError):
    """A vector table is not what its manifest, or the caller, says."""


class VectorStore:
    """Tables under one folder: ``<name>/vectors`` (id, embedding, ...) and ``<name>/manifest``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, part: str = "") -> str:
        return f"{self.root}/{name}/{part}".rstrip("/")

    def manifest(self, name: str) -> dict:
        path = self._path(name, "manifest")
        if not exists(self.spark, path):
            raise StoreError(f"{name} has no manifest")
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def check(self, vectors: DataFrame, dim: int | None = None, unit: bool = True) -> dict:
        """Counts and norms in one job; raises for nulls, repeated ids, other dimensions, non-finite or non-unit vectors."""
        s = vector_stats(vectors, "embedding").first()
        ids = vectors.agg(F.count("*").alias("n"), F.count("embedding").alias("v"), F.count(F.nullif(F.col("id").cast("string"), F.lit(""))).alias("i"), F.countDistinct("id").alias("d")).first()
        if not ids["n"]:
            raise StoreError("there are no vectors")
        if not ids["n"] == ids["v"] == ids["i"] == ids["d"]:
            raise StoreError(f"ids must be unique and filled and vectors not null: {ids.asDict()}")
        if s["min_dim"] != s["max_dim"] or dim is not None and s["min_dim"] != dim:
            raise StoreError(f"dimensions {s['min_dim']} to {s['max_dim']}, {dim} expected")
        if not s["finite"]:
            raise StoreError("a vector is not finite")
        if unit and (abs(s["min_norm"] - 1) > 1e-3 or abs(s["max_norm"] - 1) > 1e-3):
            raise StoreError(f"norms {s['min_norm']} to {s['max_norm']}")
        return {"num_vectors": ids["n"], "dimension": s["min_dim"], "min_norm": s["min_norm"], "max_norm": s["max_norm"]}

    def save(self, name: str, vectors: DataFrame, config: dict, overwrite: bool = False) -> dict:
        """Write a table; refuses another configuration's name, and the same one's unless ``overwrite``."""
        path = self._path(name)
        if exists(self.spark, path):
            known = self.manifest(name)  # raises for a folder that is no store
            if known["config_hash"] != canonical_hash(config):
                raise StoreError(f"{name} holds another configuration")
            if not overwrite:
                raise StoreError(f"{name} is there already")
        stats = self.check(vectors, config.get("dimension"))
        vectors.write.mode("overwrite").parquet(self._path(name, "vectors"))
        manifest = {"version": VERSION, "name": name, "config": config, "config_hash": canonical_hash(config), "created_at": datetime.now(timezone.utc).isoformat(), **stats}
        self.spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(name, "manifest"))
        return manifest

    def load(self, name: str, config: dict | None = None) -> DataFrame:
        """The table, after its manifest, numbers and norms were checked."""
        manifest = self.manifest(name)
        if manifest["version"] != VERSION or config is not None and manifest["config_hash"] != canonical_hash(config):
            raise StoreError(f"{name} was written with another version or configuration")
        vectors = self.spark.read.parquet(self._path(name, "vectors"))
        stats = self.check(vectors, manifest["dimension"])
        if stats["num_vectors"] != manifest["num_vectors"]:
            raise StoreError(f"{stats['num_vectors']} vectors, {manifest['num_vectors']} expected")
        return vectors

    def catalogue(self) -> list[dict]:
        """Manifests of all tables; folders without one, and bare arrays of earlier versions, are listed as unmanaged."""
        fs, root = _hadoop(self.spark, self.root)
        found = sorted((f.getPath().getName(), f.isDirectory()) for f in fs.listStatus(root)) if fs.exists(root) else []
        names = [name for name, folder in found if folder or name.endswith(".npy")]
        return [self.manifest(n) if exists(self.spark, self._path(n, "manifest")) else {"name": n.removesuffix(".npy"), "unmanaged": True} for n in names]

    def find(self, spec: ModelSpec, variant: str) -> str:
        """The name of the one table of an encoder and a text variant; raises if there is none or more than one."""
        want = {"model_id": spec.model_id, "model_revision": spec.model_revision, "text_variant": variant}
        names = [m["name"] for m in self.catalogue() if not m.get("unmanaged") and all(m["config"].get(k) == v for k, v in want.items())]
        if len(names) != 1:
            raise StoreError(f"{len(names)} tables of text {variant} ({', '.join(names)}), there must be one")
        return names[0]

    def reuse_check(self, name: str, config: dict) -> dict:
        """Whether a stored table fits a configuration, and where they differ."""
        if not exists(self.spark, self._path(name, "manifest")):
            return {"reusable": False, "differences": {"name": [None, name]}}
        known = self.manifest(name)["config"]
        differ = {k: [known.get(k), config.get(k)] for k in sorted({*known, *config}) if known.get(k) != config.get(k)}
        return {"reusable": not differ, "differences": differ}

    def get_or_compute(self, name: str, config: dict, compute: Callable[[], DataFrame]) -> DataFrame:
        if not self.reuse_check(name, config)["reusable"]:
            self.save(name, compute(), config, overwrite=True)
        return self.load(name, config)


def encode(records: DataFrame, text: str, load_model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64, prefix: str = "") -> DataFrame:
    """``records`` with unit vectors of ``text``.  ``load_model`` runs once per task and returns the encoder of a batch."""
    schema = T.StructType([*records.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    at = records.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                model = model or load_model()
                v = np.asarray(model([prefix + (t or "") for t in part.column(at).to_pylist()]), dtype=np.float64)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))], schema.names)

    return records.mapInArrow(run, schema)
