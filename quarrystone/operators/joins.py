"""Joins with a rule of their own: fallbacks, prefixes, slices, key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import without_version


def missing_keys(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``known``; a check passes if there is none."""
    return df.join(known, list(keys), "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(only_first, only_second): how many keys only one side has."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    sides = x.withColumn("_s", F.lit(1)).unionByName(y.withColumn("_s", F.lit(2)))
    per = sides.groupBy(*keys).agg(F.sum("_s").alias("_s"))
    return per.agg(F.count_if(F.col("_s") == 1).alias("only_first"), F.count_if(F.col("_s") == 2).alias("only_second"))


def versioned(df: DataFrame, other: DataFrame, key: str, ident: str) -> DataFrame:
    """Left join on an id with a version: the full id first, else the smallest id
    of the same base. Every row of ``df`` stays once; of repeated ids in
    ``other`` one row is taken."""
    row = F.struct(*[F.col(c) for c in other.columns])
    full = other.groupBy(F.col(ident).alias("_full")).agg(F.min(row).alias("_same"))
    base = other.groupBy(without_version(F.col(ident)).alias("_base")).agg(F.min_by(row, ident).alias("_near"))
    found = df.join(full, F.col(key) == F.col("_full"), "left").join(base, without_version(F.col(key)) == F.col("_base"), "left")
    best = F.coalesce("_same", "_near")
    return found.select(*df.columns, *[best[c].alias(c) for c in other.columns])


def longest_prefix(df: DataFrame, node: str, prefixes: DataFrame, prefix: str, delimiter: str = "<") -> DataFrame:
    """Left join of a node with the longest prefix that is the node, or ends before the delimiter in it.

    A prefix must end at a delimiter, so the candidates of a node are its own
    parts: an equi-join, not a comparison with every prefix.
    """
    parts = F.split(F.col(node), delimiter)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), delimiter))
    found = df.select(node).distinct().withColumn("_head", F.explode(heads)).join(prefixes.select(F.col(prefix).alias("_head")), "_head")
    best = found.groupBy(node).agg(F.max_by("_head", F.length("_head")).alias(prefix))
    return df.join(best, node, "left")


def clade_or_self(df: DataFrame, node: str, clades: DataFrame, species: DataFrame) -> DataFrame:
    """``members`` of a node: of its clade (name, members), else the species of that name, else none."""
    name = F.regexp_replace(node, "<[^>]*>$", "")
    rows = df.withColumn("_name", name).join(clades.select(F.col("name").alias("_name"), F.col("members").alias("_clade")), "_name", "left")
    rows = rows.join(species.select(F.col("species").alias("_name"), F.array("species").alias("_own")), "_name", "left")
    return rows.withColumn("members", F.coalesce("_clade", "_own", F.array().cast("array<string>"))).drop("_name", "_clade", "_own")


def slices(fragments: DataFrame, records: DataFrame) -> DataFrame:
    """Fragments (alias, start, end; first place 0, end exclusive) of records (aliases, seq): joined on any alias, then cut."""
    named = records.select(F.explode("aliases").alias("alias"), "seq")
    cut = F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start"))
    return fragments.join(named, "alias").withColumn("part", cut).drop("seq")


def by_sequence(missing: DataFrame, present: DataFrame) -> DataFrame:
    """(label, stands_for): for each missing (label, seq) the smallest present label with that sequence."""
    first = present.groupBy(F.md5("seq").alias("_d"), "seq").agg(F.min("label").alias("stands_for"))
    return missing.withColumn("_d", F.md5("seq")).join(first, ["_d", "seq"], "left").select("label", "stands_for")


def with_fallback(df: DataFrame, mapping: DataFrame, key: str, new: str) -> DataFrame:
    """The key replaced by what ``mapping`` (key, new) says, itself if it says nothing."""
    return df.join(mapping, key, "left").withColumn(key, F.coalesce(new, key)).drop(new)


def two_hop(df: DataFrame, key: str, merged: DataFrame, known: DataFrame) -> DataFrame:
    """Left join with ``known`` by what ``merged`` (old, new) makes of the key, or by the key itself."""
    now = df.join(merged.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(key) == F.col("_old"), "left").withColumn("_key", F.coalesce("_new", key)).drop("_old", "_new")
    return now.join(known.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def matched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two tables that must have the same keys; a key that one side lacks is an error when the rows are read."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), list(keys), "full")
    lacking = F.raise_error(F.concat(F.lit("only one table has "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("boolean")
    return both.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), lacking).otherwise(True)).drop("_a", "_b")


def renamed(df: DataFrame, mapping: DataFrame, key: str, new: str) -> DataFrame:
    """The key replaced by ``mapping`` (key, new); a key that it lacks is an error when the rows are read."""
    joined = df.join(mapping, key, "left")
    return joined.withColumn(key, F.when(F.col(new).isNull(), F.raise_error(F.concat(F.lit("no name for "), F.col(key).cast("string"))).cast(mapping.schema[new].dataType)).otherwise(F.col(new))).drop(new)


def with_counts(df: DataFrame, key: str, **counted: DataFrame) -> DataFrame:
    """A column per named table: how many of its rows have the key, 0 where none."""
    for name, rows in counted.items():
        df = df.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return df.na.fill(0, list(counted))
