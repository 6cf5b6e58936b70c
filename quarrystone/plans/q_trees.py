"""Queries of trees: region, nation and customer are levels of one tree; literal gene trees are reconciled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.operators import ancestors as an
from quarrystone.operators import splits
from quarrystone.operators import trees as tr
from quarrystone.plans.base import table
from quarrystone.plans.register import query

EDGES = """edges AS (
  SELECT 'C' || c_custkey AS node, 'N' || c_nationkey AS parent FROM customer UNION ALL
  SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'root' FROM region
), reach AS (
  SELECT node, node AS ancestor, 0 AS steps FROM (SELECT node FROM edges UNION SELECT 'root')
  UNION ALL SELECT r.node, e.parent, r.steps + 1 FROM reach r JOIN edges e ON r.ancestor = e.node
)"""


def _edges(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e = c.select(name("C", "c_custkey").alias("node"), name("N", "c_nationkey").alias("parent"))
    e = e.unionByName(n.select(name("N", "n_nationkey").alias("node"), name("R", "n_regionkey").alias("parent")))
    return e.unionByName(r.select(name("R", "r_regionkey").alias("node"), F.lit("root").alias("parent")))


@query(f"WITH RECURSIVE {EDGES} SELECT * FROM reach")
def tree_closure(spark, sf_dir):
    return tr.closure(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES} SELECT node, steps AS depth FROM reach WHERE ancestor = 'root'")
def tree_distance(spark, sf_dir):
    return an.lifting(_edges(spark, sf_dir)).places.where("depth > 0 or node = 'root'").select("node", "depth")


@query(f"""WITH RECURSIVE {EDGES}, pairs AS (SELECT 'C' || c_custkey AS a, 'C' || (c_custkey + 1) AS b FROM customer WHERE c_custkey + 1 < (SELECT count(*) FROM customer)),
m AS (SELECT a, b, x.ancestor AS lca, x.steps + y.steps AS distance FROM pairs JOIN reach x ON x.node = a JOIN reach y ON y.node = b AND y.ancestor = x.ancestor)
SELECT a, b, arg_min(lca, distance) AS lca, min(distance) AS distance FROM m GROUP BY 1, 2""")
def lca_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    last = c.agg(F.max("c_custkey")).first()[0]
    name = lambda x: F.concat(F.lit("C"), x.cast("string"))
    pairs = c.where(F.col("c_custkey") < last).select(name(F.col("c_custkey")).alias("a"), name(F.col("c_custkey") + 1).alias("b"))
    return an.common_ancestor(pairs, an.lifting(_edges(spark, sf_dir))).select("a", "b", "lca", "distance")


# A chain of orders: each hangs from the one before it of the same customer, all of them from the customer; a branch is as long as the days between.
CHAINS = """dated AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderkey) OVER w AS before, lag(o_orderdate) OVER w AS earlier FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
links AS (SELECT o_orderkey AS node, coalesce(before, -1 - o_custkey) AS parent, CAST(coalesce(date_diff('day', CAST(earlier AS DATE), CAST(o_orderdate AS DATE)), 1) AS DOUBLE) AS length FROM dated),
tree AS (SELECT DISTINCT parent AS node, 0 AS depth, 0.0::DOUBLE AS far FROM links WHERE parent < 0 UNION ALL SELECT l.node, t.depth + 1, t.far + l.length FROM tree t JOIN links l ON l.parent = t.node)"""


def _chains(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    dated = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderdate").over(w).alias("earlier"))
    days = F.datediff(F.col("o_orderdate").cast("date"), F.col("earlier").cast("date"))
    return dated.select(F.col("o_orderkey").alias("node"), F.coalesce("before", -1 - F.col("o_custkey")).alias("parent"), F.coalesce(days, F.lit(1)).cast("double").alias("length"))


@query(f"""WITH RECURSIVE {CHAINS} SELECT node, depth, far AS distance FROM tree""")
def root_distance(spark, sf_dir):
    """Steps and branch lengths from the root to each node of deep chains."""
    return an.lifting(_chains(spark, sf_dir)).places.select("node", "depth", "distance")


@query(f"""WITH RECURSIVE {CHAINS}, pair AS (SELECT o_custkey, max(o_orderkey) AS a, min(o_orderkey) AS b FROM orders GROUP BY 1 HAVING count(*) > 1),
met AS (SELECT a, b, x.depth AS dx, y.depth AS dy, x.far AS fx, y.far AS fy FROM pair JOIN tree x ON x.node = a JOIN tree y ON y.node = b)
SELECT a, b, CASE WHEN dx < dy THEN a ELSE b END AS lca, abs(dx - dy) AS distance, abs(fx - fy) AS length FROM met""")
def lca_lengths(spark, sf_dir):
    """Common ancestors in chains, with the branch lengths between."""
    pairs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("a"), F.min("o_orderkey").alias("b"), F.count("*").alias("n")).where("n > 1")
    return an.common_ancestor(pairs, an.lifting(_chains(spark, sf_dir))).select("a", "b", "lca", "distance", "length")


@query(f"""WITH RECURSIVE {CHAINS}, pair AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 3 = 0 THEN max(o_orderkey) OVER w ELSE -1 - o_custkey END AS ancestor FROM orders WINDOW w AS (PARTITION BY o_custkey))
SELECT p.node, p.ancestor, CASE WHEN a.depth <= t.depth THEN t.depth - a.depth ELSE -1 END AS steps, CASE WHEN a.depth <= t.depth THEN t.far - a.far ELSE -1.0 END AS length FROM pair p JOIN tree t ON t.node = p.node JOIN tree a ON a.node = p.ancestor""")
def ancestor_distances(spark, sf_dir):
    """The way up to an ancestor; -1 where the other node is none."""
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    pairs = orders.join(last, "o_custkey").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") % 3 == 0, F.col("last")).otherwise(-1 - F.col("o_custkey")).alias("ancestor"))
    found = an.ancestor_distance(pairs, an.lifting(_chains(spark, sf_dir)))
    return found.select("node", "ancestor", F.coalesce("steps", F.lit(-1)).alias("steps"), F.coalesce("length", F.lit(-1.0)).alias("length"))


@query(f"""WITH RECURSIVE {EDGES} SELECT ancestor AS node, count(*) AS leaves FROM reach WHERE starts_with(node, 'C') GROUP BY 1""")
def leaf_counts(spark, sf_dir):
    reach = tr.closure(_edges(spark, sf_dir)).where(F.col("node").startswith("C"))
    return reach.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("leaves"))


# Gene families: ten customers each, their species by nation. A family's number shapes its tree: three to five inner nodes, polytomies
# among them, roots of two or more children; customers of the last nation are in no map, so their families cannot be reconciled.
SPECIES = "((A:1,B:1):1,(C:1,D:1,E:1):1);"
_INNER = 5


def families(spark, sf_dir):
    """(family, f, n, newick, genes): node j's parent is (f + j * j) % j, leaf i hangs from node i / 2; node 0 of every fourth family has none."""
    member = F.struct("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_nationkey") != 24, F.substring(F.lit("ABCDE"), F.col("c_nationkey") % 5 + 1, 1)).alias("species"))
    f, n = F.col("f"), F.col("n")
    rows = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 10).alias("f")).agg(F.sort_array(F.collect_list(member)).alias("leaves"), F.count("*").alias("n"))
    rows = rows.withColumn("m", F.greatest(F.lit(1), F.least(3 + f % 3, F.floor(n / 2))))
    m = F.col("m")
    at = lambda i: F.when((f % 4 == 0) & (m > 2) & (i < 2), 1).otherwise(F.least(F.floor(i / 2), m - 1))
    leaves_at = lambda j: F.transform(F.filter("leaves", lambda x, i: at(i) == j), lambda x: F.concat(x["name"], F.lit(":1")))
    text: dict[int, Column] = {}
    for j in reversed(range(_INNER)):
        own = leaves_at(j)
        below = [F.when((F.lit(k) < m) & ((f + k * k) % k == j), text[k]) for k in range(j + 1, _INNER)]
        tail = F.concat(((f * 13 + j * 7) % 100).cast("string"), F.lit(f":{j + 1}")) if j else F.lit(";")
        text[j] = F.concat(F.lit("("), F.concat_ws(",", own, *below), F.lit(")"), tail)
    mapped = F.filter("leaves", lambda x: x["species"].isNotNull())
    genes = F.map_from_arrays(F.transform(mapped, lambda x: x["name"]), F.transform(mapped, lambda x: x["species"]))
    return rows.select(f.cast("string").alias("family"), "f", "n", text[0].alias("newick"), genes.alias("genes"))


#: The same trees as edges; ``reach`` goes from an edge's one end away from the other, so (at, prev) are the nodes of that side as a root there sees them.
FAMILIES = """leaf AS (SELECT c_custkey // 10 AS f, 'c' || c_custkey AS name, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_custkey // 10) AS n,
  CASE WHEN c_nationkey <> 24 THEN substr('ABCDE', CAST(c_nationkey % 5 + 1 AS INTEGER), 1) END AS species FROM customer WINDOW w AS (PARTITION BY c_custkey // 10 ORDER BY c_custkey)
), shape AS (SELECT f, n, greatest(1, least(3 + f % 3, n // 2)) AS m, bool_or(species IS NULL) AS bad FROM leaf GROUP BY f, n
), link AS (
  SELECT l.f, 'L' || i AS a, 'N' || (CASE WHEN l.f % 4 = 0 AND m > 2 AND i < 2 THEN 1 ELSE least(i // 2, m - 1) END) AS b, 1 AS long FROM leaf l JOIN shape s ON l.f = s.f
  UNION ALL SELECT f, 'N' || j, 'N' || ((f + j * j) % j), j + 1 FROM shape, range(1, 5) AS r(j) WHERE j < m
), twin AS (SELECT f, min(a) AS a, max(a) AS b, sum(long) AS long FROM link WHERE b = 'N0' GROUP BY f HAVING count(*) = 2
), edge AS (SELECT l.* FROM link l LEFT JOIN twin t ON t.f = l.f AND l.b = 'N0' WHERE t.f IS NULL UNION ALL SELECT * FROM twin
), view AS MATERIALIZED (SELECT f, a AS x, b AS y FROM edge UNION ALL SELECT f, b, a FROM edge
), reach AS (
  SELECT f, x, y, x AS cur, y AS prev FROM view
  UNION ALL SELECT r.f, r.x, r.y, v.x, v.y FROM reach r JOIN view v ON v.f = r.f AND v.y = r.cur AND v.x <> r.prev
)"""

RECONCILED = f"""WITH RECURSIVE {FAMILIES}, side AS MATERIALIZED (
  SELECT r.f, r.x, r.y, list(l.name ORDER BY l.name) AS names, list(DISTINCT l.species) AS kinds FROM reach r JOIN leaf l ON l.f = r.f AND r.cur = 'L' || l.i GROUP BY ALL
), place(kinds_of, node, depth, size) AS (VALUES (['A'], 'A', 2, 1), (['B'], 'B', 2, 1), (['C'], 'C', 2, 1), (['D'], 'D', 2, 1), (['E'], 'E', 2, 1), (['A', 'B'], 'S001', 1, 2), (['C', 'D', 'E'], 'S002', 1, 3), (['A', 'B', 'C', 'D', 'E'], 'SROOT', 0, 5)
), lost(top, low, gone, step) AS (VALUES ('SROOT', 'S001', 'S002', 0), ('SROOT', 'S002', 'S001', 0), ('S001', 'A', 'B', 0), ('S001', 'B', 'A', 0), ('S002', 'C', 'D', 0), ('S002', 'C', 'E', 0), ('S002', 'D', 'C', 0), ('S002', 'D', 'E', 0), ('S002', 'E', 'C', 0), ('S002', 'E', 'D', 0),
  ('SROOT', 'A', 'S002', 0), ('SROOT', 'A', 'B', 1), ('SROOT', 'B', 'S002', 0), ('SROOT', 'B', 'A', 1), ('SROOT', 'C', 'S001', 0), ('SROOT', 'C', 'D', 1), ('SROOT', 'C', 'E', 1), ('SROOT', 'D', 'S001', 0), ('SROOT', 'D', 'C', 1), ('SROOT', 'D', 'E', 1), ('SROOT', 'E', 'S001', 0), ('SROOT', 'E', 'C', 1), ('SROOT', 'E', 'D', 1)
), seen AS MATERIALIZED (SELECT s.f, x, y, names, arg_min(node, size) AS node, arg_min(depth, size) AS depth FROM side s JOIN shape h ON h.f = s.f AND NOT h.bad JOIN place ON list_has_all(kinds_of, kinds) GROUP BY ALL
), parts AS ( -- what hangs from a node as seen from y; a root on an edge is a node of its own
  SELECT v.f, v.x, v.y, v.node, v.depth, v.names, k.x AS kid, k.node AS kid_node, k.depth AS kid_depth FROM seen v JOIN seen k ON k.f = v.f AND k.y = v.x AND k.x <> v.y
), whole AS (SELECT h.f, arg_min(node, size) AS node, arg_min(depth, size) AS depth FROM (SELECT f, list(DISTINCT species) AS kinds FROM leaf GROUP BY f) h JOIN place ON list_has_all(kinds_of, kinds) GROUP BY h.f
), roots AS MATERIALIZED (SELECT a.f, a.x, a.y, a.names AS one, b.names AS other, w.node, w.depth FROM seen a JOIN seen b ON b.f = a.f AND b.x = a.y AND b.y = a.x AND a.x < a.y JOIN whole w ON w.f = a.f
), joint AS MATERIALIZED (
  SELECT f, x, y, node, depth, len(names) AS n, kid, kid_node, kid_depth FROM parts
  UNION ALL SELECT r.f, 'root:' || r.x, r.y, r.node, r.depth, len(one) + len(other), s.x, s.node, s.depth FROM roots r JOIN seen s ON s.f = r.f AND ((s.x = r.x AND s.y = r.y) OR (s.x = r.y AND s.y = r.x))
), event AS MATERIALIZED (SELECT f, x, y, node, n, bool_or(kid_node = node) AS dup, sum(kid_depth - depth) - CASE WHEN bool_or(kid_node = node) THEN 0 ELSE count(*) END AS losses FROM joint GROUP BY f, x, y, node, depth, n
), rooted AS MATERIALIZED ( -- the nodes of each rooting, as it sees them
  SELECT r.f, r.x AS rx, r.y AS ry, t.cur AS x, t.prev AS y FROM roots r JOIN reach t ON t.f = r.f AND ((t.x = r.x AND t.y = r.y) OR (t.x = r.y AND t.y = r.x)) WHERE t.cur LIKE 'N%'
  UNION ALL SELECT f, x, y, 'root:' || x, y FROM roots
), cost AS (SELECT r.f, rx, ry, count_if(dup) AS dups, sum(losses) AS losses, count_if(NOT dup) AS specs FROM rooted r JOIN event e USING (f, x, y) GROUP BY r.f, rx, ry
), ranked AS MATERIALIZED (
  SELECT c.*, r.node, dups + losses AS total, min(dups + losses) OVER (PARTITION BY c.f) AS least,
    row_number() OVER (PARTITION BY c.f ORDER BY dups + losses, dups, losses, CASE WHEN (len(one), one) < (len(other), other) THEN array_to_string(one, '|') || '||' || array_to_string(other, '|') ELSE array_to_string(other, '|') || '||' || array_to_string(one, '|') END) AS nth
  FROM cost c JOIN roots r ON r.f = c.f AND r.x = rx AND r.y = ry
), optimal AS (SELECT f, count(*) AS roots FROM ranked WHERE total = least GROUP BY f
), shared AS (SELECT r.f, CASE WHEN r.x LIKE 'root:%' THEN 'root' ELSE r.x END AS x, e.node, count(*) AS times FROM rooted r JOIN ranked k ON k.f = r.f AND k.rx = r.rx AND k.ry = r.ry AND total = least JOIN event e ON e.f = r.f AND e.x = r.x AND e.y = r.y WHERE e.dup GROUP BY ALL
), best AS MATERIALIZED (SELECT r.*, e.node, e.n, e.dup, CASE WHEN r.x LIKE 'root:%' THEN 'root' ELSE r.x END AS name FROM rooted r JOIN ranked k ON k.f = r.f AND k.rx = r.rx AND k.ry = r.ry AND k.nth = 1 JOIN event e ON e.f = r.f AND e.x = r.x AND e.y = r.y
), label AS (SELECT f, 'L' || i AS x, name FROM leaf UNION ALL SELECT f, 'N' || j, CASE WHEN j = 0 THEN '' ELSE CAST((f * 13 + j * 7) % 100 AS VARCHAR) END FROM shape, range(5) AS r(j) UNION ALL SELECT f, 'root', 'root_induced' FROM shape)
SELECT CAST(h.f AS VARCHAR) AS family, 'family' AS kind, k.node AS species_node, CASE WHEN NOT bad THEN CAST(n AS INTEGER) ELSE -1 END AS n_genes, NULL::DOUBLE AS robustness, NULL AS support, CAST(coalesce(dups, -1) AS INTEGER) AS duplications, CAST(coalesce(losses, -1) AS INTEGER) AS losses, CAST(coalesce(specs, -1) AS INTEGER) AS speciations, CAST(coalesce(roots, -1) AS INTEGER) AS optimal_roots,
  (SELECT string_agg(CASE WHEN dup THEN 'D@' ELSE 'S@' END || b.node, ' ' ORDER BY dup DESC, b.node) FROM best b WHERE b.f = h.f) AS labels, CASE WHEN bad THEN 'leaves and map differ' END AS error
FROM shape h LEFT JOIN ranked k ON k.f = h.f AND k.nth = 1 LEFT JOIN optimal o ON o.f = h.f
UNION ALL SELECT CAST(b.f AS VARCHAR), 'duplication', b.node, CAST(b.n AS INTEGER), round(times / roots, 6), l.name, -1, -1, -1, -1, NULL, NULL
FROM best b JOIN optimal o ON o.f = b.f JOIN shared s ON s.f = b.f AND s.x = b.name AND s.node = b.node JOIN label l ON l.f = b.f AND l.x = b.name WHERE dup
UNION ALL SELECT CAST(b.f AS VARCHAR), 'loss', gone, CAST(p.size AS INTEGER), NULL, l.name, -1, -1, -1, -1, NULL, NULL
FROM best b JOIN joint j ON j.f = b.f AND j.x = b.x AND j.y = b.y JOIN lost ON top = b.node AND low = j.kid_node AND (dup OR step > 0) JOIN place p ON p.node = gone JOIN label l ON l.f = b.f AND l.x = j.kid"""


@query(RECONCILED)
def reconcile_dl(spark, sf_dir):
    """All rows of every family: totals with the labels of the tree written, duplications, lost branches, and what could not be reconciled."""
    got = tr.reconcile_families(families(spark, sf_dir), SPECIES)
    labels = F.array_join(F.array_sort(F.regexp_extract_all("newick", F.lit(r"\)([DS]@[A-Z0-9]+)"))), " ")
    known = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_genes", "duplications", "losses", "speciations", "optimal_roots")]
    return got.select("family", "kind", "species_node", F.round("robustness", 6).alias("robustness"), "support", *known, labels.alias("labels"), "error")


@query("""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS tree_id, c_custkey % 9 + 1.0::DOUBLE AS b FROM customer), h AS (SELECT *, greatest(3.0, 1 + b) AS top FROM t)
SELECT tree_id, name, round(CASE name WHEN 'A' THEN 100.0 WHEN '' THEN 100 / top ELSE 100 * (top - 1) / top END, 6) AS branch_length, CASE name WHEN 'A' THEN 1 WHEN '' THEN 1 ELSE 2 END AS depth, CASE name WHEN 'A' THEN 1 WHEN '' THEN 1 WHEN 'B' THEN 1 + b ELSE 3 END::DOUBLE AS distance FROM h CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('')) v(name)""")
def newick_nodes(spark, sf_dir):
    """Tips are moved out to one height, which is scaled to 100."""
    b = (F.col("c_custkey") % 9 + 1).cast("string")
    trees = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tree_id"), F.concat(F.lit("(A:1,(B:"), b, F.lit(",C:2):1);")).alias("newick"))
    nodes = tr.ultrametric(tr.node_table(trees)).where("parent_id is not null")
    return nodes.select("tree_id", "name", F.round("branch_length", 6).alias("branch_length"), "depth", "distance")


@query(f"""WITH RECURSIVE {FAMILIES}, far AS (SELECT f, 'N0' AS node, 0 AS distance FROM shape UNION ALL SELECT k.f, k.a, distance + long FROM far r JOIN link k ON k.f = r.f AND k.b = r.node),
tips AS (SELECT f, max(distance) AS top, min(distance) AS low, count(*) AS tips FROM far WHERE node LIKE 'L%' GROUP BY f)
SELECT CAST(t.f AS VARCHAR) AS tree_id, tips, top::DOUBLE AS height, top > low AS uneven_before, false AS uneven_after, round(sum(long + CASE WHEN a LIKE 'L%' THEN top - distance ELSE 0 END) * 100 / top, 6) AS length
FROM tips t JOIN link k ON k.f = t.f JOIN far d ON d.f = k.f AND d.node = k.a GROUP BY t.f, tips, top, low""")
def ultrametric_check(spark, sf_dir):
    """Families' trees before and after their tips are moved out to one height and all is scaled to 100."""
    nodes = written(tr.node_table(families(spark, sf_dir), "family"), "nodes")
    even = written(tr.ultrametric(nodes), "nodes")
    leaf = F.col("is_leaf")
    before = nodes.groupBy("tree_id").agg(F.count_if(leaf).alias("tips"), F.max(F.when(leaf, F.col("distance"))).alias("height"))
    lengths = even.groupBy("tree_id").agg(F.round(F.sum("branch_length"), 6).alias("length"))
    odd = lambda df, name: tr.uneven(df).select("tree_id", F.col("uneven").alias(name))
    sides = (odd(nodes, "uneven_before"), odd(even, "uneven_after"), lengths)
    return reduce(lambda a, b: a.join(b.hint("merge"), "tree_id"), sides, before)


#: What an edge parts of the leaves ``chosen`` (f, x, name), each standing for ``names``: its length, and the side without the first leaf.
PARTED = """ends AS (SELECT r.f, r.x, r.y, list(s.name) AS few, list_sort(list_distinct(flatten(list(s.names)))) AS names FROM reach r JOIN chosen s ON s.f = r.f AND s.x = r.cur GROUP BY r.f, r.x, r.y),
parted AS (SELECT a.f, e.long, a.few AS x, b.few AS y, CASE WHEN list_min(a.names) < list_min(b.names) THEN b.names ELSE a.names END AS part, len(a.names) AS n, len(b.names) AS k FROM edge e JOIN ends a ON a.f = e.f AND a.x = e.a AND a.y = e.b JOIN ends b ON b.f = e.f AND b.x = e.b AND b.y = e.a)"""


@query(f"""WITH RECURSIVE {FAMILIES}, chosen AS (SELECT f, 'L' || i AS x, name, [name] AS names, species FROM leaf WHERE species IN ('A', 'B', 'C')), {PARTED},
tree AS (SELECT f, CAST(sum(long) AS DOUBLE) AS length, count(DISTINCT part) FILTER (n > 1 AND k > 1) AS splits FROM parted GROUP BY f),
tags AS (SELECT f, count(*) FILTER (species = 'A') AS test, count(*) FILTER (species = 'B') AS reference, string_agg(name || CASE species WHEN 'A' THEN '{{test}}' WHEN 'B' THEN '{{reference}}' ELSE '' END, ' ' ORDER BY name) AS leaves FROM chosen GROUP BY f)
SELECT CAST(f AS VARCHAR) AS family, leaves, CAST(test AS INTEGER) AS test, CAST(reference AS INTEGER) AS reference, test >= 2 AND reference >= 2 AS can_relax, coalesce(splits, 0) AS splits, coalesce(length, 0.0) AS length FROM tags LEFT JOIN tree USING (f)""")
def pruned_trees(spark, sf_dir):
    """Families' trees of the leaves of three species, two of them tagged: who is left, how many carry each tag, whether that suffices, and what splits and length remain."""
    of = lambda *kinds: F.map_keys(F.map_filter("genes", lambda k, v: v.isin(*kinds)))
    tags = F.transform_values(F.map_filter("genes", lambda k, v: v.isin("A", "B")), lambda k, v: F.when(v == "A", "test").otherwise("reference"))
    rows = families(spark, sf_dir).select("family", "newick", of("A", "B", "C").alias("keep"), tags.alias("tags")).where(F.size("keep") > 0)  # no tree without a leaf
    trees = written(tr.pruned_column(rows, "newick", "keep", "tags", "tree").select("family", "tree", "test", "reference", "can_relax"), "pruned")
    leaves = F.array_join(F.array_sort(F.regexp_extract_all("tree", F.lit(r"(c[0-9]+(?:\{[a-z]+\})?)"))), " ")
    parts = splits.bipartitions(trees, "family", "tree", trivial=True).groupBy(F.col("tree_id").alias("family")).agg(F.count_if(F.col("size") > 1).alias("splits"), F.sum("length").alias("length"))
    return trees.join(parts, "family", "left").select("family", leaves.alias("leaves"), "test", "reference", "can_relax", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("length", F.lit(0.0)).alias("length"))


@query(RECONCILED[: RECONCILED.index(", optimal AS")].rstrip().removesuffix(")") + """)
SELECT CAST(k.f AS VARCHAR) AS family, CASE WHEN (len(one), one) < (len(other), other) THEN array_to_string(one, '|') || '||' || array_to_string(other, '|') ELSE array_to_string(other, '|') || '||' || array_to_string(one, '|') END AS split
FROM ranked k JOIN roots r ON r.f = k.f AND r.x = rx AND r.y = ry WHERE nth = 1""")
def rerooted_trees(spark, sf_dir):
    """Families' trees rooted where those of least cost are, of which only the split of the leaves is taken."""
    known = families(spark, sf_dir)
    best = tr.reconcile_families(known, SPECIES).where("kind = 'family' and error is null").select("family", F.regexp_replace("newick", r"\)[^:;,()]*", ")").alias("reference"))
    trees = tr.rerooted_column(known.join(best, "family"), "newick", "reference", "tree").select("family", "tree")
    nodes = written(tr.node_table(trees, "family", "tree").withColumns({c: F.concat_ws("/", "tree_id", c) for c in ("node_id",)} | {"parent_id": F.when(F.col("parent_id").isNotNull(), F.concat_ws("/", "tree_id", "parent_id"))}), "nodes")
    sides = nodes.where("depth = 1").select(F.col("node_id").alias("ancestor"))
    reach = tr.closure(nodes.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent")))
    below = nodes.where("is_leaf").join(reach, F.col("node") == F.col("node_id")).join(sides, "ancestor").groupBy("tree_id", "ancestor").agg(F.array_sort(F.collect_list("name")).alias("names"))
    both = below.groupBy(F.col("tree_id").alias("family")).agg(F.array_sort(F.collect_list(F.struct(F.size("names").alias("n"), "names"))).alias("sides"))
    return both.select("family", F.array_join(F.transform("sides", lambda x: F.array_join(x["names"], "|")), "||").alias("split"))


@query(f"""WITH RECURSIVE {FAMILIES}, kind AS (SELECT f, 'L' || i AS x, name, c_nationkey AS nation FROM leaf JOIN customer ON name = 'c' || c_custkey),
groups AS (SELECT f, nation, list_sort(list(name)) AS names, arg_min(x, name) AS x, min(name) AS name FROM kind GROUP BY f, nation), chosen AS (SELECT f, x, name, names FROM groups), {PARTED},
every AS (SELECT f, list_sort(list(name)) AS every FROM kind GROUP BY f),
parts AS (SELECT f, part FROM parted WHERE n > 1 AND k > 1 UNION SELECT f, CASE WHEN names[1] = every[1] THEN list_filter(every, lambda x: NOT list_contains(names, x)) ELSE names END FROM groups JOIN every USING (f) WHERE len(names) > 1 AND len(names) < len(every) - 1)
SELECT CAST(e.f AS VARCHAR) AS family, CAST(len(every) AS INTEGER) AS leaves, (SELECT count(DISTINCT part) FROM parts p WHERE p.f = e.f) AS splits, coalesce((SELECT CAST(sum(long) AS DOUBLE) FROM parted p WHERE p.f = e.f), 0.0) AS length FROM every e""")
def restored_leaves(spark, sf_dir):
    """Trees of one customer of each nation of a family, to which the others of the nation are put back."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 10).cast("string").alias("family"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("MKL"), F.col("c_nationkey").cast("string")).alias("seq"))
    firsts = c.groupBy("family", "seq").agg(F.min("name").alias("name")).groupBy("family").agg(F.collect_list("name").alias("keep"))
    sequences = c.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("name", "seq"))).alias("sequences"))
    kept = tr.pruned_column(families(spark, sf_dir).join(firsts, "family").withColumn("tags", F.create_map().cast("map<string,string>")), "newick", "keep", "tags", "some").select("family", "some").join(sequences, "family")
    trees = written(tr.restored_column(kept, "some", "sequences", "tree").select("family", "tree"), "restored")
    leaves = F.size(F.regexp_extract_all("tree", F.lit(r"(c[0-9]+)")))
    parts = splits.bipartitions(trees, "family", "tree", trivial=True).groupBy(F.col("tree_id").alias("family")).agg(F.count_if(F.col("size") > 1).alias("splits"), F.sum("length").alias("length"))
    return trees.join(parts, "family", "left").select("family", leaves.alias("leaves"), F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("length", F.lit(0.0)).alias("length"))


@query("""WITH groups AS (SELECT c_custkey // 12 AS tree_id, c_custkey, c_mktsegment AS seg, c_custkey % 2 AS half, c_nationkey % 2 AS nation FROM customer),
sides AS (
  SELECT tree_id, 'own' AS side, list(c_custkey ORDER BY c_custkey) AS part FROM groups GROUP BY tree_id, seg UNION SELECT tree_id, 'own', list(c_custkey ORDER BY c_custkey) FROM groups GROUP BY tree_id, seg, half
  UNION SELECT tree_id, 'other', list(c_custkey ORDER BY c_custkey) FROM groups GROUP BY tree_id, seg UNION SELECT tree_id, 'other', list(c_custkey ORDER BY c_custkey) FROM groups GROUP BY tree_id, seg, nation
), known AS (SELECT tree_id, list(c_custkey ORDER BY c_custkey) AS every FROM groups GROUP BY tree_id),
named AS (SELECT DISTINCT tree_id, side, CASE WHEN part[1] = every[1] THEN list_filter(every, lambda x: NOT list_contains(part, x)) ELSE part END AS part FROM sides JOIN known USING (tree_id) WHERE len(part) > 1 AND len(part) < len(every) - 1),
met AS (SELECT coalesce(a.tree_id, b.tree_id) AS tree_id, a.part AS x, b.part AS y FROM (FROM named WHERE side = 'own') a FULL JOIN (FROM named WHERE side = 'other') b ON a.tree_id = b.tree_id AND a.part = b.part)
SELECT CAST(tree_id AS VARCHAR) AS tree_id, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (y IS NULL) AS extra, count(*) FILTER (x IS NULL OR y IS NULL) = 0 AS equal FROM met GROUP BY 1""")
def bipartition_agreement(spark, sf_dir):
    """Trees of twelve customers, grouped by segment and within by number, against those grouped within by nation: splits that both have, and that one lacks."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 12).alias("tree_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 2).alias("half"), (F.col("c_nationkey") % 2).alias("nation"))
    nested = lambda df, by, x: df.groupBy(*by).agg(F.concat(F.lit("("), F.array_join(F.collect_list(x), ","), F.lit(")")).alias("text"))

    def tree(by: str) -> DataFrame:
        inner = nested(nested(c, ["tree_id", "seg", by], "name"), ["tree_id", "seg"], "text")
        return nested(inner, ["tree_id"], "text").withColumn("newick", F.concat("text", F.lit(";")))

    return splits.agreement(splits.compared(splits.bipartitions(tree("half")), splits.bipartitions(tree("nation"))))
