"""Ancestors by binary lifting: a node's ancestors 1, 2, 4, ... steps up.

Level k + 1 joins level k with itself, so a tree of n nodes and depth d takes
log d joins and n log d rows, where every pair of a node and an ancestor would
be n d. Depths, distances and common ancestors go up by descending levels.
The tables of a large forest compress well, so that Spark would broadcast them
by the size of their files; they are joined by shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.core.shared import written

#: Joins after which a table is written, so that plans of deep trees stay small.
EVERY = 6


@dataclass
class Lifting:
    """``levels[k]``: (node, ancestor, length) 2^k steps up, for nodes that deep;
    ``places``: (node, root, depth, distance) of every node."""

    levels: list[DataFrame]
    places: DataFrame


def lifting(edges: DataFrame) -> Lifting:
    """The levels of a forest (node, parent, optionally length; a missing
    length is 0). A parent that is no node itself is a root, as is a node with a
    null parent. A node with two parents and a cycle are errors."""
    length = F.coalesce(F.col("length").cast("double"), F.lit(0.0)) if "length" in edges.columns else F.lit(0.0)
    base = written(edges.select("node", F.col("parent").alias("ancestor"), length.alias("length")).where("node is not null or ancestor is not null"), "lifting")
    one = base.where("node is not null and ancestor is not null")
    n, different = one.agg(F.count("*"), F.count_distinct("node")).first()
    if n != different:
        raise ValueError("a node has two parents")
    roots = base.select(F.coalesce("ancestor", "node").alias("node")).distinct().join(one, "node", "left_anti")
    # A node's jump ends at its root: jumps that have got there stay as they are, and only those that went all 2^k steps, the level, go on.
    here = written(roots.select("node", F.col("node").alias("ancestor"), F.lit(0.0).alias("length"), F.lit(0).alias("steps")), "lifting")
    going = one.select("node", "ancestor", "length", F.lit(1).alias("steps"))
    levels, size = [one], 1
    while True:
        a, b = going.alias("a"), here.unionByName(going).alias("b").hint("merge")
        gone = written(
            a.join(b, F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.length") + F.col("b.length")).alias("length"), (F.col("a.steps") + F.col("b.steps")).alias("steps")), "lifting"
        )
        size *= 2
        here, going = here.unionByName(gone.where(F.col("steps") < size)), gone.where(F.col("steps") == size)
        if going.isEmpty():
            break
        if size > n:
            raise ValueError("the parents form a cycle")
        levels.append(going.select("node", "ancestor", "length"))
    return Lifting(levels, here.select("node", F.col("ancestor").alias("root"), F.col("steps").alias("depth"), F.col("length").alias("distance")))


def common_ancestor(pairs: DataFrame, tree: Lifting) -> DataFrame:
    """(a, b, lca, distance, length) of pairs of nodes: the steps and the branch
    lengths from one to the other by way of ``lca``. Pairs of different trees,
    and of nodes that the forest lacks, are left out."""
    place = lambda x: tree.places.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("depth").alias(f"depth_{x}"), F.col("distance").alias(f"far_{x}"))
    both = pairs.select("a", "b").join(place("a").hint("merge"), "a").join(place("b").hint("merge"), "b").where("root_a = root_b").drop("root_a", "root_b")
    deeper, steps = F.col("depth_a") >= F.col("depth_b"), 0
    both = both.select("a", "b", "depth_a", "depth_b", "far_a", "far_b", F.when(deeper, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(deeper, F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("depth_a") - F.col("depth_b")).alias("rest"))

    def up(rows: DataFrame, k: int, *names: str) -> DataFrame:
        nonlocal steps
        for x in names:
            rows = rows.join(tree.levels[k].select(F.col("node").alias(x), F.col("ancestor").alias(f"{x}_up")).hint("merge"), x, "left")
            steps += 1
        if steps >= EVERY:
            rows, steps = written(rows, "climbing"), 0
        return rows

    for k in reversed(range(len(tree.levels))):  # the deeper one first, to the depth of the other
        here = F.shiftright("rest", k).bitwiseAND(F.lit(1)) == 1
        both = up(both, k, "x").withColumn("x", F.when(here, F.col("x_up")).otherwise(F.col("x"))).drop("x_up")
    for k in reversed(range(len(tree.levels))):  # then both, as long as they stay apart
        apart = F.col("x_up") != F.col("y_up")
        both = up(both, k, "x", "y").withColumns({c: F.when(apart, F.col(f"{c}_up")).otherwise(F.col(c)) for c in "xy"}).drop("x_up", "y_up")
    both = up(both, 0, "x").withColumn("lca", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("x_up")))
    top = tree.places.select(F.col("node").alias("lca"), F.col("depth").alias("depth"), F.col("distance").alias("far"))
    return both.join(top.hint("merge"), "lca").select("a", "b", "lca", (F.col("depth_a") + F.col("depth_b") - 2 * F.col("depth")).alias("distance"), (F.col("far_a") + F.col("far_b") - 2 * F.col("far")).alias("length"))


def ancestor_distance(pairs: DataFrame, tree: Lifting) -> DataFrame:
    """(node, ancestor, steps, length) of pairs; where ``ancestor`` is none of the node's, steps and length are null.

    Depths say how far up the ancestor must be, so only the node climbs, and
    only in pairs of one tree whose ancestor is neither the root nor too deep.
    """
    place = lambda x: tree.places.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("root", "depth", "distance")])
    both = pairs.select("node", "ancestor").join(place("node").hint("merge"), "node", "left").join(place("ancestor").hint("merge"), "ancestor", "left")
    rest = F.when(F.col("root_node") == F.col("root_ancestor"), F.col("depth_node") - F.col("depth_ancestor"))
    placed = written(both.select("node", "ancestor", rest.alias("steps"), (F.col("distance_node") - F.col("distance_ancestor")).alias("length"), F.col("depth_ancestor").alias("deep")), "placed")
    climbs = F.coalesce((F.col("steps") > 0) & (F.col("deep") > 0), F.lit(False))
    met = lambda rows, found: rows.select("node", "ancestor", F.when(found, F.col("steps")).alias("steps"), F.when(found, F.col("length")).alias("length"))
    settled = met(placed.where(~climbs), ((F.col("steps") > 0) & (F.col("deep") == 0)) | ((F.col("steps") == 0) & (F.col("node") == F.col("ancestor"))))
    rows = placed.where(climbs).select("node", "ancestor", "steps", "length", F.col("node").alias("x"))
    for done, k in enumerate(reversed(range(len(tree.levels))), 1):
        up = rows.join(tree.levels[k].select(F.col("node").alias("x"), F.col("ancestor").alias("x_up")).hint("merge"), "x", "left")
        rows = up.withColumn("x", F.when(F.shiftright("steps", k).bitwiseAND(F.lit(1)) == 1, F.col("x_up")).otherwise(F.col("x"))).drop("x_up")
        if done % EVERY == 0:
            rows = written(rows, "climbing")
    return settled.unionByName(met(rows, F.col("x") == F.col("ancestor")))
