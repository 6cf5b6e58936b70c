"""Rootings, splits and ancestors against brute force over every rooting, set and path."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import newick
from quarrystone.functions.newick import Tree
from quarrystone.operators import ancestors, rooting, splits, trees

SPECIES = "((A:1,(B:1,C:1)bc:1):1,((D:1,E:1,F:1):1,G:1):1);"


def random_tree(rng, leaves, twin_root=True):
    """Newick text of a tree over ``leaves``, with polytomies and, at times, a root that only joins two edges."""
    nodes = [f"{n}:{rng.randrange(9)}" for n in leaves]
    rng.shuffle(nodes)
    while len(nodes) > 1:
        k = min(len(nodes), rng.choice([2, 2, 2, 3, 4]))
        if len(nodes) - k == 1 and not twin_root:
            k += 1
        some = [nodes.pop(rng.randrange(len(nodes))) for _ in range(k)]
        nodes.append("(" + ",".join(some) + f"){rng.randrange(100)}:{rng.randrange(9)}")
    return nodes[0].rsplit(":", 1)[0] + ";"


def all_rootings(tree):
    """The tree rebuilt at every edge."""
    graph = rooting.Unrooted(tree)
    return [graph.rooted(*edge) for edge in graph.edges()]


def split_at_root(tree):
    sets = tree.leaf_sets()
    return "||".join("|".join(side) for side in sorted((sorted(sets[c]) for c in tree.down[0]), key=lambda side: (len(side), side)))


def brute_rooting(text, species_of, species, duplication, loss):
    found = []
    for rooted, origin in all_rootings(newick.parse(text)):
        r = trees.reconcile(rooted, species_of, species)
        found.append((duplication * r["n_dup"] + loss * r["n_loss"], r["n_dup"], r["n_loss"], split_at_root(rooted), rooted, origin, r))
    found.sort(key=lambda x: x[:4])
    optimal = [x for x in found if abs(x[0] - found[0][0]) < 1e-9]
    shared = Counter((origin[i], r["at"][i]) for *_, rooted, origin, r in optimal for i in range(len(rooted.up)) if r["event"][i] == "duplication")
    return found, len(optimal), shared


@pytest.mark.parametrize("seed", range(4))
def test_best_rooting_by_all_rootings(seed):
    rng, species = random.Random(seed), trees.SpeciesTree(SPECIES)
    for case in range(80):
        names = [f"{rng.choice('pqrs')}{i}" for i in range(rng.randrange(2, 14))]
        genes = {n: rng.choice("ABCDEFG"[: rng.randrange(1, 8)]) for n in names}
        text = random_tree(rng, names, case % 2 == 0)
        costs = rng.choice([(1.0, 1.0), (2.0, 0.5), (0.0, 1.0), (1.0, 0.0)])
        got = trees.best_rooting(text, genes, species, *costs)
        found, optimal, shared = brute_rooting(text, genes, species, *costs)
        best = found[0]
        assert (got["cost"], got["n_dup"], got["n_loss"], got["signature"]) == best[:4], text
        assert (got["optimal"], got["rootings"]) == (optimal, len(found)) and +got["shared"] == +shared
        assert split_at_root(got["tree"]) == best[3] and got["n_spec"] == best[6]["n_spec"]
        assert newick.write(got["tree"]) in {newick.write(x[4]) for x in found if x[:4] == best[:4]}


@pytest.mark.parametrize("shape", ["chain", "star", "halves"])
def test_five_thousand_leaves(shape):
    names = [f"g{i}" for i in range(5000)]
    genes = {n: "ABCDEFG"[i * i % 7] for i, n in enumerate(names)} if shape != "star" else dict.fromkeys(names, "A")
    if shape == "star":
        text = "(" + ",".join(names) + ");"
    elif shape == "chain":
        text = "(" * 4999 + names[0] + "".join(f",{n})" for n in names[1:]) + ";"
    else:
        parts = names
        while len(parts) > 1:
            parts = [f"({a},{b})" for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        text = parts[0] + ";"
    began = time.time()
    got = trees.best_rooting(text, genes, trees.SpeciesTree(SPECIES))
    assert time.time() - began < 20 and got["rootings"] == (5000 if shape == "star" else 9997)
    assert trees.rooted_like(newick.write(got["tree"]), newick.write(got["tree"])) == newick.write(got["tree"])


def test_single_leaves_and_gaps_are_errors():
    species = trees.SpeciesTree(SPECIES)
    rows = trees.reconciled_rows("f", "a;", {"a": "A"}, species, 1.0, 1.0)
    assert [r["error"] for r in rows] == ["a single leaf has no root"]
    assert "differ" in trees.reconciled_rows("f", "(a,b);", {"a": "A"}, species, 1.0, 1.0)[0]["error"]
    assert "error" not in trees.reconciled_rows("f", "(a,b);", {"a": "A", "b": "B"}, species, 1.0, 1.0)[0]


def test_rooted_like_any_rooting():
    rng = random.Random(3)
    for _ in range(60):
        names = [f"g{i}" for i in range(rng.randrange(3, 12))]
        tree = newick.parse(random_tree(rng, names))
        for rooted, _ in all_rootings(tree):
            text = newick.write(rooted)
            assert split_at_root(newick.parse(trees.rooted_like(newick.write(tree), text))) == split_at_root(rooted)


def brute_splits(text):
    tree = newick.parse(text)
    sets = tree.leaf_sets()
    return {frozenset((s, sets[0] - s)) for s in sets if 1 < len(s) < len(sets[0]) - 1}


def test_bipartitions_by_sets(spark):
    rng, rows = random.Random(7), []
    for i in range(40):
        names = [f"g{k}" for k in range(rng.randrange(4, 9))]
        rows.append((i, random_tree(rng, names), random_tree(rng, names if i % 5 else [*names[1:], "other"])))
    rows += [(100, rows[1][1], newick.write(all_rootings(newick.parse(rows[1][1]))[2][0])), (101, None, "((a,b),(c,d));"), (102, "(((a,b)),((c,d)));", "((a,b),c,d);")]
    table = spark.createDataFrame(rows, "tree_id int, newick string, other string")
    got = {r.tree_id: r for r in splits.agreement(splits.compared(splits.bipartitions(table), splits.bipartitions(table, text="other"))).collect()}
    for i, a, b in rows:
        x, y = brute_splits(a) if a else set(), brute_splits(b)
        if x | y:
            assert (got[str(i)].shared, got[str(i)].extra, got[str(i)].missing) == (len(x & y), len(x - y), len(y - x))
    assert got["100"].equal and got["102"].equal and not got["101"].equal and splits.bipartitions(table.limit(0)).count() == 0
    assert {r[2:] for r in splits.splits_of("((a:1,b:1):2,(c:1,d:1):3);") if r[2] == 2} == {(2, 4, 5.0)}
    with pytest.raises(ValueError, match="repeat"):
        splits.splits_of("((a,a),b);")


def climbed(parent, node):
    out = [node]
    while parent.get(out[-1]) is not None:
        out.append(parent[out[-1]])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_by_climbing(spark, seed):
    rng = random.Random(seed)
    parent = {i: rng.randrange(max(0, i - 5), i) if i % 60 else None for i in range(300)}
    length = {i: rng.randrange(100) / 4 for i in parent}
    rows = [(i, p, length[i] if i % 11 else None) for i, p in parent.items()]
    far = lambda way, top: sum(length[x] if x % 11 else 0.0 for x in way[: way.index(top)])
    tree = ancestors.lifting(spark.createDataFrame(rows, "node long, parent long, length double"))
    ways = {i: climbed(parent, i) for i in parent}
    got = {r.node: (r.root, r.depth, r.distance) for r in tree.places.collect()}
    assert got == {i: (w[-1], len(w) - 1, far(w, w[-1])) for i, w in ways.items()}
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(400)] + [(7, 7), (0, 0), (5, 999)]
    want = Counter()
    for a, b in pairs:
        for top in [x for x in ways.get(a, []) if x in ways.get(b, [])][:1]:
            want[a, b, top, ways[a].index(top) + ways[b].index(top), far(ways[a], top) + far(ways[b], top)] += 1
    table = spark.createDataFrame(pairs, "a long, b long")
    assert Counter(map(tuple, ancestors.common_ancestor(table, tree).collect())) == want
    up = {(r.node, r.ancestor): (r.steps, r.length) for r in ancestors.ancestor_distance(table.toDF("node", "ancestor"), tree).collect()}
    assert up == {(a, b): (ways[a].index(b), far(ways[a], b)) if b in ways.get(a, []) else (None, None) for a, b in pairs}


def test_chain_of_a_hundred_thousand(spark):
    n = 100_000
    chain = spark.range(n).select((F.col("id") * 7919 % n).alias("node")).select("node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), (F.col("node") % 3).cast("double").alias("length"))
    tree = ancestors.lifting(chain)
    assert len(tree.levels) == 17 and sum(level.count() for level in tree.levels) < 17 * n
    assert tree.places.where("depth <> node or root <> 0").isEmpty() and tree.places.count() == n
    pairs = spark.range(50).select((F.col("id") * 1999).alias("a"), (F.col("id") * 17 + 90_000).alias("b"))
    for r in ancestors.common_ancestor(pairs, tree).collect():
        assert (r.lca, r.distance, r.length) == (min(r.a, r.b), abs(r.b - r.a), float(sum(x % 3 for x in range(min(r.a, r.b) + 1, max(r.a, r.b) + 1))))


def test_cycles_and_two_parents_are_errors(spark):
    edges = lambda *rows: spark.createDataFrame(rows, "node string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        ancestors.lifting(edges(("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")))
    with pytest.raises(ValueError, match="two parents"):
        ancestors.lifting(edges(("a", "b"), ("a", "c")))
    assert ancestors.lifting(edges(("a", "b")).limit(0)).places.count() == 0
