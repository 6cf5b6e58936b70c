"""Trees as tables, and reconciliation of gene trees with a species tree.

Closures, common ancestors and distances are joins and recursive queries over
(node, parent) tables. What needs a whole tree runs a family at a time, in
time linear in its nodes (see ``rooting``); a family is one row of Newick text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.functions import newick
from quarrystone.functions.newick import Tree
from quarrystone.operators.rooting import Costs, Unrooted, smallest_signature
from quarrystone.operators.splits import FULL, leaf_sums


#: Trees that a Python worker holds as objects at a time, however long Spark's batches are.
TREES = 200


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TREES):
            yield batch.slice(at, TREES)


def node_table(df: DataFrame, ident: str = "tree_id", text: str = "newick") -> DataFrame:
    """(tree_id, node_id, parent_id, name, branch_length, depth, distance, is_leaf) of each row's Newick text."""

    schema = pa.schema([("tree_id", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("name", pa.string()), ("branch_length", pa.float64()), ("depth", pa.int32()), ("distance", pa.float64()), ("is_leaf", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows = []
            for key, value in zip(part["tree_id"].to_pylist(), part["newick"].to_pylist()):
                t = newick.parse(value)
                for i, (depth, far) in enumerate(zip(t.depths(), t.distances())):
                    rows.append((key, i, t.up[i] if t.up[i] >= 0 else None, t.name[i], t.length[i], depth, far, not t.down[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "tree_id string, node_id int, parent_id int, name string, branch_length double, depth int, distance double, is_leaf boolean"
    return df.where(F.col(text).isNotNull()).select(F.col(ident).cast("string").alias("tree_id"), F.col(text).alias("newick")).mapInArrow(run, ddl)


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, steps) of a table (node, parent), each node its own ancestor at 0 steps.

    Paths double each round, so the rounds are the logarithm of the depth. A
    path longer than the table has rows is a cycle, and an error.
    """
    most = edges.count()
    one = edges.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    reach, step = one, 1
    while True:
        a, b = reach.alias("a"), reach.alias("b")
        longer = a.join(b, (F.col("a.ancestor") == F.col("b.node")) & (F.col("a.steps") == step)).select(F.col("a.node"), F.col("b.ancestor"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        longer = written(longer, "paths")  # else each round would walk all rounds before it again
        if longer.isEmpty():
            break
        if step > most:
            raise ValueError("the parents form a cycle")
        reach, step = reach.unionByName(longer), step * 2
    own = edges.select("node").unionByName(edges.select(F.col("parent").alias("node")).where("node is not null")).distinct()
    return reach.unionByName(own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")))


def ultrametric(nodes: DataFrame, age: float = 100.0) -> DataFrame:
    """Tips moved out to the largest distance of their tree, all lengths scaled to ``age``."""
    top = nodes.where("is_leaf").groupBy("tree_id").agg(F.max("distance").alias("_top"))
    length = F.coalesce("branch_length", F.lit(0.0)) + F.when(F.col("is_leaf"), F.col("_top") - F.col("distance")).otherwise(0.0)
    return nodes.join(top.hint("merge"), "tree_id").withColumn("branch_length", F.when(F.col("parent_id").isNotNull(), length * age / F.col("_top"))).drop("_top")


def uneven(nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(tree_id, uneven): whether tips of a tree (node_id, parent_id, branch_length) differ in height by more than ``tolerance``, or a branch is negative.

    A tree's rows are summed along its own paths, as many rounds as it is deep.
    All joins are of large tables: as they compress well, Spark would take some
    for small and send them through the driver, once a round.
    """
    up = written(nodes.select("tree_id", "node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("length"), "is_leaf"), "heights")
    now = up.where("is_leaf").select("tree_id", F.col("node_id").alias("leaf"), F.col("parent_id").alias("at"), F.col("length").alias("height"))
    step = up.select(F.col("tree_id"), F.col("node_id").alias("at"), F.col("parent_id").alias("next"), "length")
    while not now.where("at is not null").isEmpty():
        now = written(now.join(step.hint("merge"), ["tree_id", "at"], "left").select("tree_id", "leaf", F.col("next").alias("at"), (F.col("height") + F.coalesce("length", F.lit(0.0))).alias("height")), "heights")
    spread = now.groupBy("tree_id").agg((F.max("height") - F.min("height")).alias("spread"))
    negative = up.groupBy("tree_id").agg(F.min("length").alias("least"))
    return spread.join(negative.hint("merge"), "tree_id").select("tree_id", ((F.col("spread") > tolerance) | (F.col("least") < 0)).alias("uneven"))


class SpeciesTree:
    """Ancestors and names of a rooted species tree."""

    def __init__(self, text: str):
        self.tree = t = newick.parse(text)
        self.depth, self.sets = t.depths(), t.leaf_sets()
        self.by_name = {t.name[i]: i for i in t.leaves()}
        inner = sorted((i for i, d in enumerate(t.down) if d and i), key=lambda i: (len(self.sets[i]), sorted(self.sets[i])))
        self.ids = {i: f"S{n:03d}" for n, i in enumerate(inner, 1)} | {0: "SROOT"} | {i: t.name[i] for i in t.leaves()}

    def meet(self, a: int, b: int) -> int:
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.tree.up[a]
        return a

    def beside(self, top: int, low: int, skip: bool) -> list[int]:
        """Nodes beside the way from ``top`` down to ``low``; ``skip`` leaves out those next to the first step."""
        way = []
        while low != top:
            way.append(low)
            low = self.tree.up[low]
        way.reverse()
        return [s for k, node in enumerate(way) if k >= skip for s in self.tree.down[self.tree.up[node]] if s != node]


def reconcile(tree: Tree, species_of: dict[str, str], species: SpeciesTree) -> dict:
    """Duplications, losses and speciations of a rooted gene tree, by common ancestors."""
    n = len(tree.up)
    at, event = [0] * n, [""] * n
    counts, losses = Counter(), []
    for i in range(n - 1, -1, -1):
        down = tree.down[i]
        if not down:
            if tree.name[i] not in species_of:
                raise ValueError(f"{tree.name[i]} has no species")
            at[i], event[i] = species.by_name[species_of[tree.name[i]]], "leaf"
            continue
        at[i] = at[down[0]]
        for c in down[1:]:
            at[i] = species.meet(at[i], at[c])
        event[i] = "duplication" if any(at[c] == at[i] for c in down) else "speciation"
        counts[event[i]] += 1
        for c in down:
            losses.extend((i, c, s) for s in species.beside(at[i], at[c], event[i] == "speciation"))
            # A child far below also loses one branch beside each step; counted by steps, as a polytomy loses several.
            steps = species.depth[at[c]] - species.depth[at[i]]
            counts["losses"] += max(0, steps - (event[i] == "speciation"))
    return {"at": at, "event": event, "losses": losses, "n_dup": counts["duplication"], "n_spec": counts["speciation"], "n_loss": counts["losses"]}


def best_rooting(text: str, species_of: dict[str, str], species: SpeciesTree, duplication: float = 1.0, loss: float = 1.0) -> dict:
    """The rooting of least cost, ties by duplications, losses and the split at
    the root; and how many optimal rootings share each duplication."""
    tree = newick.parse(text)
    names = [tree.name[i] for i in tree.leaves()]
    if len(names) != len(set(names)) or set(names) != set(species_of):
        raise ValueError("leaves and map differ")
    graph = Unrooted(tree)
    if len(graph.order) < 2:
        raise ValueError("a single leaf has no root")
    costs = Costs(graph, species_of, species)
    found = {}
    for x in graph.order[1:]:
        r = costs.rooting(x)
        found[x] = (duplication * r.dups + loss * r.losses, r.dups, r.losses)
    least = min(found.values())
    optimal = [x for x, cost in found.items() if abs(cost[0] - least[0]) < 1e-9]
    edge, split = smallest_signature(graph, [x for x, cost in found.items() if cost == least])
    rooted, origin = next(graph.rooted(a, b, x) for a, b, x in graph.edges() if graph.lower(a, b) == edge)
    r = reconcile(rooted, species_of, species)
    return r | {"tree": rooted, "origin": origin, "cost": least[0], "signature": split, "optimal": len(optimal), "rootings": len(found), "shared": costs.shared_duplications(optimal)}


RECONCILED = "family string, kind string, node string, species_node string, n_genes int, robustness double, support string, duplications int, losses int, speciations int, optimal_roots int, newick string, error string"


def reconcile_families(families: DataFrame, species_newick: str, duplication: float = 1.0, loss: float = 1.0) -> DataFrame:
    """Reconciliation of each row (family, newick, genes: map of leaf to species).

    One long table: a row of kind family with totals and the labelled tree, one
    of kind duplication per event, one of kind loss per lost branch; a family
    that cannot be reconciled gives a family row with ``error`` set.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in RECONCILED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        species = SpeciesTree(species_newick)
        for part in _slices(batches):
            rows = [r for f in part.to_pylist() for r in reconciled_rows(f["family"], f["newick"], dict(f["genes"] or ()), species, duplication, loss)]
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return families.select("family", "newick", "genes").mapInArrow(run, RECONCILED)


def reconciled_rows(family: str, text: str, genes: dict[str, str], species: SpeciesTree, duplication: float, loss: float) -> list[dict]:
    try:
        r = best_rooting(text or "", genes, species, duplication, loss)
    except (ValueError, KeyError, IndexError) as e:
        return [{"family": family, "kind": "family", "error": str(e)}]
    t, sizes, event, at = r["tree"], r["tree"].leaf_counts(), r["event"], r["at"]
    numbers = {i: f"G{n:04d}" for n, i in enumerate((i for i in t.postorder() if t.down[i]), 1)}
    names = [f"{event[i][0].upper()}@{species.ids[at[i]]}" if t.down[i] else t.name[i] for i in range(len(t.up))]
    totals = {"duplications": r["n_dup"], "losses": r["n_loss"], "speciations": r["n_spec"], "optimal_roots": r["optimal"]}
    rows = [{"family": family, "kind": "family", "species_node": species.ids[at[0]], "n_genes": sizes[0], "newick": newick.write(t, names)} | totals]
    for i in range(len(t.up)):
        if event[i] == "duplication":
            robust, support = r["shared"][r["origin"][i], at[i]] / r["optimal"], "root_induced" if r["origin"][i] < 0 else t.name[i]
            rows.append({"family": family, "kind": "duplication", "node": numbers[i], "species_node": species.ids[at[i]], "n_genes": sizes[i], "robustness": robust, "support": support})
    for _, c, s in r["losses"]:
        rows.append({"family": family, "kind": "loss", "node": numbers.get(c, t.name[c]), "species_node": species.ids[s], "n_genes": len(species.sets[s]), "support": t.name[c]})
    return rows


def pruned(text: str, keep: set[str], tags: dict[str, str] | None = None) -> str:
    """The tree of the kept leaves without inner labels; nodes with one child are joined; leaves get {tag} if they have one."""
    tree = newick.parse(text)
    # What is kept below each node, as (name, length, parts), from the leaves up: no recursion, so trees may be deep.
    below: dict[int, list[tuple]] = {}
    for node in tree.postorder():
        length = (tree.length[node] or 0.0) if node else 0.0
        parts = [p for c in tree.down[node] for p in below.pop(c)]
        if not tree.down[node]:
            below[node] = [(tree.name[node], length, [])] if tree.name[node] in keep else []
        elif len(parts) == 1:
            name, under, inner = parts[0]
            below[node] = [(name, length + under, inner)]
        else:
            below[node] = [("", length, parts)] if parts else []
    if not below[0]:
        raise ValueError("no leaf is kept")
    out, stack = Tree(), [(-1, below[0][0])]
    while stack:
        up, (name, length, inner) = stack.pop()
        tag = (tags or {}).get(name)
        node = out.add(up, f"{name}{{{tag}}}" if tag else name, length)
        stack.extend((node, p) for p in reversed(inner))
    return newick.write(out)


def tag_counts(text: str) -> dict[str, int]:
    """How many leaves carry each {tag}."""
    tree = newick.parse(text)
    return dict(Counter(n[n.index("{") + 1 : -1] for n in (tree.name[i] for i in tree.leaves()) if n.endswith("}")))


def can_relax(text: str, least: int = 2) -> bool:
    """Whether a tagged tree has at least ``least`` test and as many reference leaves."""
    counts = tag_counts(text)
    return counts.get("test", 0) >= least and counts.get("reference", 0) >= least


def rooted_like(text: str, reference: str) -> str:
    """The tree rooted so that its root parts the leaves as the reference's does."""
    tree, other = newick.parse(text), newick.parse(reference)
    names, wanted = ({t.name[i] for i in t.leaves()} for t in (tree, other))
    if names != wanted:
        raise ValueError(f"leaves differ: {sorted(names ^ wanted)}")
    if len(other.down[0]) != 2:
        raise ValueError("the reference is not rooted")
    sides = {s for s, up in zip(leaf_sums(other), other.up) if up == 0}
    if len(tree.down[0]) == 2 and {s for s, up in zip(leaf_sums(tree), tree.up) if up == 0} == sides:
        return newick.write(tree)
    graph = Unrooted(tree)
    below, whole = graph.sums()
    for a, b, x in graph.edges():
        one = below[graph.lower(a, b)]
        if {one, (whole - one) & FULL} == sides:
            return newick.write(graph.rooted(a, b, x)[0])
    raise ValueError("the tree has no such root")


def with_identical(text: str, sequences: dict[str, str]) -> str:
    """The tree with every label of ``sequences`` that it lacks put beside the
    smallest leaf of the same sequence, at no distance."""
    tree = newick.parse(text)
    there = {tree.name[i] for i in tree.leaves()}
    stands: dict[str, str] = {}
    for name in sorted(there, reverse=True):
        stands[sequences[name]] = name
    beside: dict[str, list[str]] = {}
    for name in sorted(set(sequences) - there):
        if sequences[name] not in stands:
            raise ValueError(f"{name} has a sequence that no leaf has")
        beside.setdefault(stands[sequences[name]], []).append(name)
    out = Tree()
    new = {-1: -1}
    for i in range(len(tree.up)):
        more = beside.get(tree.name[i], []) if not tree.down[i] else []
        new[i] = out.add(new[tree.up[i]], "" if more else tree.name[i], tree.length[i])
        for name in [tree.name[i], *more] if more else []:
            out.add(new[i], name, 0.0)
    return newick.write(out)


def _text_column(df: DataFrame, out: str, ddl: str, work, *columns: str) -> DataFrame:
    """``df`` with the column ``out`` that ``work`` makes of others, in Arrow batches; an error in a row is the job's."""
    return df.withColumn(out, F.udf(work, ddl, useArrow=True)(*map(F.col, columns)))


def pruned_column(df: DataFrame, text: str, keep: str, tags: str, out: str) -> DataFrame:
    """``pruned`` of each row (text, array of leaves, map of tags), with the numbers of test and reference leaves and whether these suffice."""

    def work(newick_text, kept, tag):
        tree = pruned(newick_text, set(kept), dict(tag or ()))
        counts = tag_counts(tree)
        return {"tree": tree, "test": counts.get("test", 0), "reference": counts.get("reference", 0), "relax": can_relax(tree)}

    done = _text_column(df, "_pruned", "tree string, test int, reference int, relax boolean", work, text, keep, tags)
    return done.withColumns({out: F.col("_pruned.tree"), "test": F.col("_pruned.test"), "reference": F.col("_pruned.reference"), "can_relax": F.col("_pruned.relax")}).drop("_pruned")


def rerooted_column(df: DataFrame, text: str, reference: str, out: str) -> DataFrame:
    """``rooted_like`` of each row."""
    return _text_column(df, out, "string", rooted_like, text, reference)


def restored_column(df: DataFrame, text: str, sequences: str, out: str) -> DataFrame:
    """``with_identical`` of each row (text, map of label to sequence)."""
    return _text_column(df, out, "string", lambda t, s: with_identical(t, dict(s)), text, sequences)


def priority(high: Column, strong: Column, duplications: Column, low: Column, optimal_roots: Column) -> Column:
    """How much a reconciled family deserves a look."""
    return 100 * high + 10 * strong + duplications - low - F.greatest(F.lit(0), optimal_roots - 1)
