"""Branches of a species tree and what happens on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def branch_table(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(node, parent, branch_type, descendants, species) of a tree given as
    (node, parent) and its closure: the leaves below each node, joined by
    semicolons. A species tree is small; its list of leaves fits a cell."""
    parents = edges.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = reach.join(parents.withColumn("_inner", F.lit(True)), "node", "left").where("_inner is null").select(F.col("node").alias("leaf"), F.col("ancestor").alias("node"))
    below = leaves.groupBy("node").agg(F.count("*").alias("descendants"), F.array_join(F.array_sort(F.collect_list("leaf")), ";").alias("species"), F.max(F.col("leaf") == F.col("node")).alias("_leaf"))
    kind = F.when(F.col("parent").isNull(), "root").when(F.col("_leaf"), "terminal").otherwise("internal")
    return below.join(edges, "node", "left").select("node", "parent", kind.alias("branch_type"), "descendants", "species")


def event_summary(branches: DataFrame, duplications: DataFrame, losses: DataFrame) -> DataFrame:
    """``branches`` with counts of duplications (family, node, support_class, robustness) and losses (family, node) on each; 0 where none."""
    d = duplications.groupBy("node").agg(
        F.countDistinct("family").alias("duplicated_families"), F.count("*").alias("duplications"), F.count_if(F.col("support_class") == "strong").alias("strong"), F.count_if(F.col("robustness") == 1.0).alias("robust")
    )
    x = losses.groupBy("node").agg(F.countDistinct("family").alias("families_with_loss"), F.count("*").alias("losses"))
    names = ["duplicated_families", "duplications", "strong", "robust", "families_with_loss", "losses"]
    return branches.join(d, "node", "left").join(x, "node", "left").na.fill(0, names)


def high_confidence(support_class: Column, robustness: Column) -> Column:
    """Strongly supported, and found under every optimal root."""
    return (support_class == "strong") & (robustness == 1.0)


def testable_families(trees: DataFrame, reconciled: DataFrame, branches: DataFrame) -> DataFrame:
    """Complete trees (grp, family, status, node) with their reconciliation (grp, family, …) and the species below the node of
    their event (grp, node, species); '' where the node is no branch."""
    known = trees.where("status = 'complete'").join(reconciled, ["grp", "family"], "left").join(branches.select("grp", "node", "species"), ["grp", "node"], "left")
    return known.withColumn("species", F.coalesce("species", F.lit("")))
