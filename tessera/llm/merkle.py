"""Merkle manifest of a dataset: every row's place in a tree of hashes, and its proof up to the root.

Leaves are ranked inside their group and cut into aligned buckets of 4,096, each a whole subtree.  An executor hands a bucket's
Arrow table to a DuckDB in its own process, which hashes it level by level with ordered ``string_agg`` and ``sha256``.  A first
pass keeps one root for each bucket; Spark combines those to subroots and the root, and joins to every bucket the siblings on
its way up, its outer proof.  A second pass walks the bucket again and ends every row's proof with the outer one, so that
neither texts nor unfinished proofs are ever shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Levels of a bucket (4,096 leaves), and levels that Spark combines before the nodes are stored.
LEVELS, STORED = 12, 6
#: Memory of an executor's DuckDB; a bucket with its proofs takes a few MB.
MEMORY = "256MB"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def counted(*fields: str | Column) -> Column:
    """The fields one after another, each its bytes, a colon and its value, or a dash if null."""
    out = []
    for f in fields:
        value = (F.col(f) if isinstance(f, str) else f).cast("string")
        out.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*out)


@lru_cache(maxsize=1)
def _engine() -> duckdb.DuckDBPyConnection:
    """One in-memory DuckDB for each worker process; it never writes to the executor's disk."""
    con = duckdb.connect(":memory:")
    for setting in ("threads = 1", f"memory_limit = '{MEMORY}'", "temp_directory = ''", "preserve_insertion_order = false"):
        con.execute(f"SET {setting}")
    return con


_PARENTS = "CREATE OR REPLACE TABLE level{up} AS SELECT pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM level{at} GROUP BY pos // 2"


def _levels(con: duckdb.DuckDBPyConnection, nodes: pa.Table, height: int) -> None:
    """Tables level0 to level<height> of a bucket: ``pos`` in the level and ``h``.  Every two neighbours give a parent, a last
    node without one is hashed alone."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TABLE level0 AS SELECT pos, h FROM nodes")
    for at in range(height):
        con.execute(_PARENTS.format(at=at, up=at + 1))


def bucket_root(nodes: pa.Table, height: int) -> str:
    con = _engine()
    _levels(con, nodes, height)
    ((root,),) = con.execute(f"SELECT h FROM level{height}").fetchall()
    return root


def bucket_proofs(rows: pa.Table, height: int, outer: list[dict]) -> pa.Table:
    """``pos, proof_sha256, folded`` of the rows (pos, h, claim): siblings inside the bucket, then the outer ones, hashed
    together; and the root that the claimed leaf and those siblings give."""
    con = _engine()
    _levels(con, rows.select(["pos", "h"]), height)
    con.register("claims", rows.select(["pos", "claim"]))
    con.execute("CREATE OR REPLACE TABLE walk AS SELECT pos AS leaf, pos AS node, claim AS folded, '' AS proof FROM claims")
    for level in range(height):
        con.execute(
            f"""CREATE OR REPLACE TABLE walk AS SELECT leaf, node // 2 AS node, proof || coalesce(h, '') AS proof,
            sha256(CASE WHEN node % 2 = 1 THEN coalesce(h, '') || folded ELSE folded || coalesce(h, '') END) AS folded
            FROM walk LEFT JOIN level{level} ON pos = xor(node, 1)"""
        )
    for step in outer:
        con.execute(
            "CREATE OR REPLACE TABLE walk AS SELECT leaf, proof || $h AS proof, sha256(CASE WHEN $l THEN $h || folded ELSE folded || $h END) AS folded FROM walk",
            {"h": step["h"] or "", "l": step["left"]},
        )
    return con.sql("SELECT leaf AS pos, sha256(proof) AS proof_sha256, folded FROM walk").to_arrow_table()


def ranked(rows: DataFrame, group: str, order: list[Column], scratch: Scratch, partitions: int) -> DataFrame:
    """``rows``, stored, with ``pos``: the gapless place in the group from 0 on.

    Rows are dealt by ranges of group and order, so a group of any size is spread; each task numbers its sorted part, and what
    the parts before hold is added, one number for each part and group.
    """
    order = [F.asc_nulls_first(group), *order]
    number = F.monotonically_increasing_id()  # the partition above 33 bits that count its rows in their order
    stored = scratch.save(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("number", number))
    stored = stored.withColumns({"part": F.shiftright("number", 33), "own": F.col("number").bitwiseAND((1 << 33) - 1)})
    parts = stored.groupBy("part", group).agg(F.count("*").alias("n"), F.min("own").alias("first"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.col(group).alias("g"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    same = (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))
    return stored.join(parts, same).withColumn("pos", F.col("own") + F.col("shift")).drop("number", "part", "own", "p", "g", "shift")


def _node_hash(children: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "h")))
    return F.sha2(F.array_join(F.transform(ordered, lambda c: c["h"]), ""), 256)


def combined(nodes: DataFrame, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Roots (``grp, h``) of the groups' trees over ``nodes`` (grp, pos, n, h; n nodes in the group), and each node's way up:
    ``grp, pos, way`` (array of struct(left, h), h null where a node is alone).

    ``depth`` is the height of the deepest tree.  A node has two children, so no group grows.
    """
    levels, level = [], nodes
    for at in range(depth):
        level = level if at % STORED or not at else scratch.save(level)
        levels.append(level.filter("n > 1").withColumn("level", F.lit(at)))
        up = level.filter("n > 1").groupBy("grp", F.shiftright("pos", 1).alias("up"), F.ceil(F.col("n") / 2).alias("m")).agg(_node_hash(F.col("h")).alias("h"))
        level = up.select("grp", F.col("up").alias("pos"), F.col("m").alias("n"), "h").unionByName(level.filter("n <= 1").select("grp", "pos", "n", "h"))
    roots = level.select("grp", "h")
    if not levels:
        return roots, nodes.select("grp", "pos", F.array().cast("array<struct<left:boolean,h:string>>").alias("way"))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    every = scratch.save(every)
    steps = nodes.select("grp", "pos", "n", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
    # A group's tree ends at the level with one node: the first where 2**level reaches n.
    steps = steps.filter("shiftleft(1L, level) < n").withColumn("at", F.expr("shiftright(pos, level)"))
    other = every.select(F.col("grp").alias("g"), F.col("level").alias("l"), F.col("pos").alias("sibling"), F.col("h").alias("s"))
    same = F.col("grp").eqNullSafe(F.col("g")) & (F.col("level") == F.col("l")) & (F.col("at").bitwiseXOR(F.lit(1)) == F.col("sibling"))
    found = steps.join(other, same, "left").groupBy("grp", "pos").agg(
        F.array_sort(F.collect_list(F.struct("level", (F.col("at") % 2 == 1).alias("left"), F.col("s").alias("h")))).alias("way")
    )
    way = F.transform("way", lambda x: F.struct(x["left"].alias("left"), x["h"].alias("h")))
    ways = nodes.select("grp", "pos").join(found.select(F.col("grp").alias("g"), F.col("pos").alias("p"), way.alias("way")), F.col("grp").eqNullSafe(F.col("g")) & (F.col("pos") == F.col("p")), "left")
    return roots, ways.select("grp", "pos", F.coalesce("way", F.array().cast("array<struct<left:boolean,h:string>>")).alias("way"))


def _height(n: int) -> int:
    """Levels above n nodes."""
    return max(0, n - 1).bit_length()


def manifest(
    docs: DataFrame,
    fields: list[str],
    group: str = "lang",
    claim: Column | None = None,
    id_col: str = "doc_id",
    levels: int = LEVELS,
) -> DataFrame:
    """:data:`PROVED` for every row: leaf over ``fields``, its group's subroot, the root, and its checked proof.

    ``claim`` is the leaf's hash that the proof is checked with, by default the leaf itself.  Leaves ascend by id in their
    group, null ids first and rows of one id in the order of their hashes; the null group is one of its own and comes first.
    Null and empty values have different leaves; texts of any length are hashed whole; repeated rows have a leaf each; other
    columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    leaf = F.sha2(counted(*fields), 256)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), leaf.alias("h"), F.coalesce(claim if claim is not None else leaf, leaf).alias("claim")
    )
    rows = scratch.save(rows)
    total = rows.count()
    partitions = max(1, min(8192, total >> levels))
    order = [F.asc_nulls_first("id"), F.asc("h"), F.asc("claim")]
    leaves = ranked(rows.withColumn("row", F.monotonically_increasing_id()), "grp", [*order, F.asc("row")], scratch, partitions).drop("row")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    dealt = leaves.join(sizes.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    dealt = scratch.save(dealt.withColumns({"bucket": F.expr(f"shiftright(pos, {levels})"), "inner": F.expr(f"pos & {(1 << levels) - 1}")}))

    # First pass: a root for each bucket.  Only a group of one bucket may end below the bucket's full height.
    def height(table: pa.Table) -> int:
        return min(levels, _height(table["size"][0].as_py()))

    def root_of(key: tuple, table: pa.Table) -> pa.Table:
        h = bucket_root(table.select(["inner", "h"]).rename_columns(["pos", "h"]), height(table))
        return pa.table({"grp": table["grp"][:1].cast(pa.string()), "pos": table["bucket"][:1], "n": pa.array([-(-table["size"][0].as_py() // (1 << levels))], pa.int64()), "h": [h]})

    buckets = scratch.save(dealt.select("grp", "bucket", "inner", "h", "size").groupBy("grp", "bucket").applyInArrow(root_of, "grp string, pos long, n long, h string"))
    most = buckets.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    subroots, ways = combined(buckets, _height(most), scratch)
    subroots = scratch.save(subroots)
    groups = subroots.count()
    tops = ranked(subroots.withColumnRenamed("grp", "name").withColumn("grp", F.lit("")), "grp", [F.asc_nulls_first("name")], scratch, max(1, min(8192, groups >> levels)))
    tops = scratch.save(tops)
    root, above = combined(tops.select("grp", "pos", F.lit(groups).cast("long").alias("n"), "h"), _height(groups), scratch)
    top = root.select("h").first()
    named = tops.select("pos", "name", F.col("h").alias("subroot")).join(above.select("pos", F.col("way").alias("last")), "pos").drop("pos")
    outer = ways.join(named, F.col("grp").eqNullSafe(F.col("name"))).select("grp", F.col("pos").alias("bucket"), F.concat("way", "last").alias("way"), "subroot")

    # Second pass: each bucket with its outer proof.
    root_hash = top["h"] if top else ""

    def prove(key: tuple, table: pa.Table, way: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([(n, pa.bool_() if k == "boolean" else pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in PROVED.split(", "))]).empty_table()
        found = bucket_proofs(table.select(["inner", "h", "claim"]).rename_columns(["pos", "h", "claim"]), height(table), way["way"][0].as_py())
        found = found.sort_by("pos")
        table = table.sort_by("inner")
        n = table.num_rows
        folded = found["folded"].combine_chunks().cast(pa.string())
        verified = pa.array([f == root_hash for f in folded.to_pylist()])
        columns = [table["id"], table["h"], pa.array([way["subroot"][0].as_py()] * n), pa.array([root_hash] * n), found["proof_sha256"].cast(pa.string()), folded, verified]
        return pa.table(columns, names=[x.split()[0] for x in PROVED.split(", ")])

    return dealt.groupBy("grp", "bucket").cogroup(outer.groupBy("grp", "bucket")).applyInArrow(prove, PROVED)


def crc32_of(column: str) -> Column:
    """Unsigned crc32 of a number's decimal digits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def tampered(fields: list[str], changed: str, every: int = 7, id_col: str = "doc_id") -> Column:
    """The leaf after one is added to ``changed`` where ``every`` divides the crc32 of the id; null elsewhere, where the leaf
    stands.  A null number stays null."""
    more = [F.col(f) + 1 if f == changed else F.col(f) for f in fields]
    return F.when(crc32_of(id_col) % every == 0, F.sha2(counted(*more), 256))


def proved_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language, checked with the tampered rows."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest(docs, fields, "lang", tampered(fields, "n_chars"))
