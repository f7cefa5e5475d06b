"""Variants of one name over a whole table, by a prefix trie kept as a table.

Every prefix of a name's words is a row, so a name meets those that it begins by an equality join; nothing is compared pair by
pair, and a hot name costs one row however many records have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import company, key_tokens, menu_key


def distinct_names(df: DataFrame, name: str, company_: str) -> DataFrame:
    """``key, company, parts, name, n``: names that are no variants by spelling alone, one shown, and their records."""
    rows = df.select(menu_key(F.col(name)).alias("key"), company(F.col(company_)).alias("company"), key_tokens(F.col(name)).alias("parts"), F.col(name).alias("name"))
    return rows.filter("key <> ''").groupBy("key", "company", "parts").agg(F.min("name").alias("name"), F.count("*").alias("n"))


def trie(names: DataFrame) -> DataFrame:
    """``company, prefix, key, parts, depth``: every beginning of every name; of a company's name those of its key by letters, of
    others those by words."""
    letters = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.array(F.substring(F.col("key"), F.lit(1), i)))
    words = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i))
    none = F.array().cast("array<array<string>>")
    steps = F.when(F.col("company") != "", letters).when(F.size("parts") > 0, words).otherwise(none)
    return names.select("company", "key", "parts", F.posexplode(steps).alias("depth", "prefix"))


def node(names: DataFrame) -> Column:
    """A name's own place in the trie."""
    return F.when(names["company"] != "", F.array(names["key"])).otherwise(names["parts"])


def name_variants(df: DataFrame, name: str, company_: str) -> DataFrame:
    """``name, n, shorter, longer, equal``: for every distinct name its records, the names that begin it, those that it begins, and
    the other spellings of its key (of any company).  Blank names take no part; an empty table gives no rows."""
    names = distinct_names(df, name, company_)
    own = names.withColumn("prefix", node(names))
    # One row a node: several spellings may share one.
    nodes = own.groupBy("company", "prefix").agg(F.count("*").alias("here"))
    above = trie(names).join(nodes, ["company", "prefix"])
    not_self = F.col("prefix") != F.when(F.col("company") != "", F.array("key")).otherwise(F.col("parts"))
    shorter = above.filter(not_self).groupBy("company", "key", "parts").agg(F.sum("here").alias("shorter"))
    longer = above.filter(not_self).groupBy("company", "prefix").agg(F.count("*").alias("longer"))
    same = names.groupBy("key").agg((F.count("*") - 1).alias("equal"))
    out = own.join(shorter, ["company", "key", "parts"], "left").join(longer, ["company", "prefix"], "left").join(same, "key")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("name", "n", zero("shorter"), zero("longer"), zero("equal"))
