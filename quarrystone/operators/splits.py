"""Bipartitions of trees as keys to join on.

An edge parts a tree's leaves in two. Either side is fingerprinted by the sum
of its leaves' 128-bit hashes, which adds up from the leaves to the root in one
pass; the smaller of the two sums names the split, whatever the rooting and the
order of children. So trees are compared by joining tables of splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import newick
from quarrystone.functions.newick import Tree

FULL = (1 << 128) - 1


def leaf_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=16).digest(), "big")


def leaf_sums(tree: Tree) -> list[int]:
    """The fingerprint of the leaves below each node."""
    out = [0 if d else leaf_hash(n) for d, n in zip(tree.down, tree.name)]
    for i in range(len(tree.up) - 1, 0, -1):
        out[tree.up[i]] = (out[tree.up[i]] + out[i]) & FULL
    return out


def splits_of(text: str) -> list[tuple[str, str, int, int, float]]:
    """(split, leaf set, leaves on the smaller side, leaves, length) of each
    split of a tree; the edges of one split, as on either side of a root, are
    one row with their lengths added up."""
    tree = newick.parse(text)
    names = [tree.name[i] for i in tree.leaves()]
    if len(set(names)) < len(names):
        raise ValueError("leaf names repeat")
    sums, counts, found = leaf_sums(tree), tree.leaf_counts(), {}
    for i in range(1, len(tree.up)):
        key = min(sums[i], (sums[0] - sums[i]) & FULL)
        if 0 < counts[i] < counts[0]:  # a root with one child parts nothing
            size, length = found.get(key, (min(counts[i], counts[0] - counts[i]), 0.0))
            found[key] = (size, length + (tree.length[i] or 0.0))
    return [(f"{key:032x}", f"{sums[0]:032x}", size, counts[0], length) for key, (size, length) in found.items()]


def bipartitions(df: DataFrame, ident: str = "tree_id", text: str = "newick", *, trivial: bool = False) -> DataFrame:
    """(tree_id, split, leaf_set, size, n_leaves, length) of each row's Newick
    text; splits of a single leaf only if ``trivial``. Null texts give no rows."""
    schema = pa.schema([("tree_id", pa.string()), ("split", pa.string()), ("leaf_set", pa.string()), ("size", pa.int32()), ("n_leaves", pa.int32()), ("length", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *s) for key, value in zip(*(c.to_pylist() for c in batch.columns)) for s in splits_of(value) if trivial or s[2] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    source = df.where(F.col(text).isNotNull()).select(F.col(ident).cast("string").alias("tree_id"), F.col(text).alias("newick"))
    return source.mapInArrow(run, "tree_id string, split string, leaf_set string, size int, n_leaves int, length double")


def compared(trees: DataFrame, references: DataFrame) -> DataFrame:
    """(tree_id, split, size, status, length, reference_length) of the splits
    (see ``bipartitions``) of trees and their references of the same id: shared,
    extra (in the tree alone) or missing (in the reference alone). Splits of
    unlike sets of leaves are never shared."""
    keys = ["tree_id", "leaf_set", "split"]
    left = trees.select(*keys, F.col("size").alias("_size"), "length")
    right = references.select(*keys, "size", F.col("length").alias("reference_length"))
    both = left.join(right, keys, "full")
    status = F.when(F.col("size").isNull(), "extra").when(F.col("_size").isNull(), "missing").otherwise("shared")
    return both.select("tree_id", "split", F.coalesce("_size", "size").alias("size"), status.alias("status"), "length", "reference_length")


def agreement(compared_splits: DataFrame) -> DataFrame:
    """(tree_id, shared, missing, extra, equal) of each pair of trees that have a split at all; ``equal`` if none is missing or extra."""
    number = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = compared_splits.groupBy("tree_id").agg(number("shared"), number("missing"), number("extra"))
    return counts.withColumn("equal", (F.col("missing") + F.col("extra")) == 0)
