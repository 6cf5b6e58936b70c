"""Queries of joins with fallbacks and of what is counted on branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import annotation as an
from quarrystone.operators import branches as br
from quarrystone.operators import events as ev
from quarrystone.operators import joins as jn
from quarrystone.operators import selection as se
from quarrystone.operators import sensitivity as sens
from quarrystone.operators import trees as tr
from quarrystone.operators import validation as va
from quarrystone.plans.base import table
from quarrystone.plans.register import query


@query("""SELECT o_orderkey, coalesce(c_name, '') AS species FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_custkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AND c_custkey % 7 <> 0""")
def two_hop_species(spark, sf_dir):
    """Numbers that were merged into others, then names; some are not known."""
    c = table(spark, sf_dir, "customer")
    merged = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    known = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("taxid"), F.col("c_name").alias("species"))
    rows = jn.two_hop(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("taxid")), "taxid", merged, known)
    return rows.select("o_orderkey", F.coalesce("species", F.lit("")).alias("species"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN NULL WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 1 THEN 'LOC' || c_custkey || '.2' ELSE 'LOC' || c_custkey || '.1' END AS ident FROM customer""")
def version_fallback(spark, sf_dir):
    """The full id, else the first of the same base."""
    c = table(spark, sf_dir, "customer")
    name = lambda v: F.concat(F.lit("LOC"), F.col("c_custkey").cast("string"), F.lit("."), v)
    wanted = c.select("c_custkey", name((F.col("c_custkey") % 3 + 1).cast("string")).alias("key"))
    known = c.where("c_custkey % 2 = 0").select(name(F.lit("1")).alias("ident")).unionByName(c.where("c_custkey % 4 = 0").select(name(F.lit("2")).alias("ident")))
    return jn.versioned(wanted, known, "key", "ident").select("c_custkey", "ident")


@query("SELECT doc_id, substr(text, doc_id % 10 + 1, 20) AS part FROM documents")
def fragment_slices(spark, sf_dir):
    """Places of records that go by either of two names."""
    d = table(spark, sf_dir, "documents")
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    records = d.select(F.array(name("a"), name("b")).alias("aliases"), F.col("text").alias("seq"))
    start = (F.col("doc_id") % 10).cast("int")
    fragments = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, name("a")).otherwise(name("b")).alias("alias"), start.alias("start"), (start + 20).alias("end"))
    return jn.slices(fragments, records).select("doc_id", "part")


@query("""WITH c AS (SELECT r_name, string_agg(n_name, ';' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c.members WHEN 1 THEN n_name ELSE '' END AS members FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN c USING (r_name)""")
def clade_members(spark, sf_dir):
    """The species of a clade's node, a species' own node, and a node that names nothing."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    clades = both.groupBy(F.col("r_name").alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("members"))
    k = F.col("c_custkey") % 3
    node = F.concat(F.when(k == 0, F.col("r_name")).when(k == 1, F.col("n_name")).otherwise(""), F.lit("<7>"))
    rows = table(spark, sf_dir, "customer").join(both, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", node.alias("node"))
    return jn.clade_or_self(rows, "node", clades, n.select(F.col("n_name").alias("species"))).select("c_custkey", F.array_join("members", ";").alias("members"))


@query("""SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS waiting FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def zero_filled_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return jn.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", done=o.where("o_orderstatus = 'F'"), waiting=o.where("o_orderstatus = 'O'"))


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def renamed_labels(spark, sf_dir):
    """Every key must have a name."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return jn.renamed(rows, names.withColumn("nation", F.col("nation").cast("string")), "nation", "name").select("c_custkey", "nation")


@query("""WITH p AS (SELECT text, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS stands_for FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS label, stands_for FROM documents LEFT JOIN p USING (text) WHERE doc_id % 3 = 0""")
def same_sequence(spark, sf_dir):
    """For labels left out, the first one kept that has the same sequence."""
    d = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("label"), F.col("text").alias("seq"), "doc_id")
    return jn.by_sequence(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"))


@query("""WITH r AS (SELECT DISTINCT p_brand, CASE WHEN p_size > 25 THEN 'up' ELSE 'down' END AS direction, p_type FROM part WHERE p_size > 40 OR p_size < 5), b AS (SELECT p_brand, direction FROM r GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT r.p_brand, r.direction, r.p_type FROM r JOIN b USING (p_brand, direction)""")
def comparison_sets(spark, sf_dir):
    """Families that grew or shrank in a species, where these are enough to compare."""
    p = table(spark, sf_dir, "part").where("p_size > 40 OR p_size < 5").withColumn("direction", F.when(F.col("p_size") > 25, "up").otherwise("down"))
    return an.comparison_sets(p, ["p_brand", "direction"], "p_type", 4)


TREE = """edges AS (SELECT n_name AS node, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'root' FROM region),
branches AS (SELECT n_name AS node, r_name AS parent, 'terminal' AS branch_type, 1 AS descendants, n_name AS species FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'root', 'internal', count(*), string_agg(n_name, ';' ORDER BY n_name) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
UNION ALL SELECT 'root', NULL, 'root', count(*), string_agg(n_name, ';' ORDER BY n_name) FROM nation)"""


def _branches(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("node"), F.lit("root").alias("parent")))
    return br.branch_table(edges, tr.closure(edges))


@query(f"WITH {TREE} SELECT * FROM branches")
def branch_table(spark, sf_dir):
    return _branches(spark, sf_dir)


DUPS = """dups AS (SELECT o_orderkey, o_custkey AS family, n_name AS node, o_orderkey % 101 AS a, o_orderkey % 97 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.5 END AS robustness FROM orders JOIN nation ON o_orderkey % 20 = n_nationkey WHERE o_orderstatus = 'F'),
classed AS (SELECT *, CASE WHEN a >= 80 AND b >= 95 THEN 'strong' WHEN a >= 80 OR b >= 95 THEN 'partial_strong' WHEN a >= 60 OR b >= 70 THEN 'moderate' ELSE 'low' END AS support_class FROM dups)"""


def _duplications(spark, sf_dir):
    n, o, k = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("o_orderkey")
    rows = o.join(n, k % 20 == n.n_nationkey)
    support = va.support_class(F.concat_ws("/", k % 101, k % 97))
    return rows.select("o_orderkey", F.col("o_custkey").alias("family"), F.col("n_name").alias("node"), support.alias("support_class"), F.when(k % 3 == 0, 1.0).otherwise(0.5).alias("robustness"))


@query(f"""WITH {TREE}, {DUPS}, losses AS (SELECT o_custkey AS family, r_name AS node FROM orders JOIN region ON o_orderkey % 4 = r_regionkey WHERE o_orderstatus = 'O'),
d AS (SELECT node, count(DISTINCT family) AS duplicated_families, count(*) AS duplications, count(*) FILTER (support_class = 'strong') AS strong, count(*) FILTER (robustness = 1) AS robust FROM classed GROUP BY 1),
x AS (SELECT node, count(DISTINCT family) AS families_with_loss, count(*) AS losses FROM losses GROUP BY 1)
SELECT node, branch_type, coalesce(duplicated_families, 0) AS duplicated_families, coalesce(duplications, 0) AS duplications, coalesce(strong, 0) AS strong, coalesce(robust, 0) AS robust, coalesce(families_with_loss, 0) AS families_with_loss, coalesce(losses, 0) AS losses
FROM branches LEFT JOIN d USING (node) LEFT JOIN x USING (node)""")
def branch_events(spark, sf_dir):
    o, r = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table(spark, sf_dir, "region")
    losses = o.join(r, F.col("o_orderkey") % 4 == r.r_regionkey).select(F.col("o_custkey").alias("family"), F.col("r_name").alias("node"))
    return br.event_summary(_branches(spark, sf_dir), _duplications(spark, sf_dir), losses).drop("parent", "descendants", "species")


@query(f"WITH {DUPS} SELECT o_orderkey, family, node FROM classed WHERE support_class = 'strong' AND robustness = 1")
def sure_duplications(spark, sf_dir):
    d = _duplications(spark, sf_dir)
    return d.where(br.high_confidence(F.col("support_class"), F.col("robustness"))).select("o_orderkey", "family", "node")


@query(f"""WITH {TREE} SELECT p_partkey AS family, 'one' AS grp, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE -1 END AS sequences, coalesce(species, '') AS species
FROM part LEFT JOIN branches ON node = CASE WHEN p_partkey % 2 = 0 THEN 'ASIA' ELSE 'nowhere' END WHERE p_size % 4 <> 0""")
def testable_families(spark, sf_dir):
    """Complete trees, what reconciliation says of them, and the species below their event."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family"), F.lit("one").alias("grp"), "p_size")
    trees = p.select("family", "grp", F.when(F.col("p_size") % 4 != 0, "complete").otherwise("failed").alias("status"), F.when(F.col("family") % 2 == 0, "ASIA").otherwise("nowhere").alias("node"))
    reconciled = p.where("family % 3 = 0").select("grp", "family", F.col("p_size").alias("sequences"))
    known = _branches(spark, sf_dir).select(F.lit("one").alias("grp"), "node", "species")
    return br.testable_families(trees, reconciled, known).select("family", "grp", F.coalesce("sequences", F.lit(-1)).alias("sequences"), "species")


BUSCO = """busco AS (SELECT n_name AS species, 80.0::DOUBLE + n_nationkey % 20 AS complete, n_nationkey * 1.5::DOUBLE AS duplicated FROM nation WHERE n_nationkey % 6 <> 5),
means AS (SELECT n_regionkey AS grp, avg(complete) AS c, avg(duplicated) AS d FROM nation JOIN busco ON n_name = species GROUP BY 1)"""


@query(f"""WITH {BUSCO}, q AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN coalesce(species, '') ELSE '' END AS event_species, CASE WHEN c_custkey % 2 = 0 AND species IS NOT NULL THEN complete ELSE c END AS complete, CASE WHEN c_custkey % 2 = 0 AND species IS NOT NULL THEN duplicated ELSE d END AS duplicated
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN busco ON n_name = species LEFT JOIN means ON grp = n_regionkey)
SELECT c_custkey, event_species, round(complete, 6) AS complete, round(least(1.0, greatest(0.0, complete / 100)) * greatest(0.0, 1 - duplicated / 100), 6) AS quality FROM q""")
def quality_factors(spark, sf_dir):
    """The quality of the species that an event's node names, else the mean of its group."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    busco = n.where(k % 6 != 5).select(F.col("n_name").alias("species"), (80.0 + k % 20).alias("complete"), (k * 1.5).alias("duplicated"))
    node = F.when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit("<3>"))).otherwise("<12>")
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == k).select("c_custkey", F.col("n_regionkey").alias("grp"), node.alias("node"))
    got = sens.proteome_quality(rows, "node", busco, n.select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("species")))
    return got.select("c_custkey", "event_species", F.round("complete", 6).alias("complete"), F.round("quality", 6).alias("quality"))


@query("""WITH e AS (SELECT c_nationkey AS family, count(*) FILTER (o_totalprice > 100000) AS candidates, count(*) AS n, max(round(o_totalprice / 1000, 6)) AS score FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> 1 GROUP BY 1)
SELECT n_nationkey AS family, CASE WHEN n_nationkey % 5 = 0 THEN 'fdr_supported' WHEN coalesce(candidates, 0) > 0 THEN 'candidate' ELSE 'family_only' END AS tier, coalesce(candidates, 0) AS candidate_events, score FROM nation LEFT JOIN e ON family = n_nationkey""")
def families_without_events(spark, sf_dir):
    """Families that no event names stay, with nothing counted."""
    n, o, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_nationkey % 4 <> 1")
    q = F.when(F.col("n_nationkey") % 5 == 0, 0.01).otherwise(0.5)
    every = n.select(F.col("n_nationkey").alias("family"), q.alias("q"))
    tier = F.when(F.col("o_totalprice") > 100000, "candidate").otherwise("supporting")
    events = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("family"), tier.alias("tier"), F.lit("expansion").alias("direction"), F.lit(False).alias("terminal"), F.round(F.col("o_totalprice") / 1000, 6).alias("score"), F.col("o_orderkey").alias("node"), F.lit(1).alias("change"), F.lit(0.5).alias("p"), F.lit(0.5).alias("q")
    )
    return ev.with_all(ev.families(events), every).select("family", "tier", "candidate_events", "score")


@query("""SELECT p_brand, coalesce(min(p_size) FILTER (p_size > 48), 0) AS smallest, coalesce(max(p_size) FILTER (p_size > 48), 0) AS largest FROM part GROUP BY 1""")
def range_or_zero(spark, sf_dir):
    return se.ranges_or_zero(table(spark, sf_dir, "part").where("p_size > 48"), table(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand", "p_size")


@query("""SELECT p_brand AS grp, count(*) AS families, count(*) FILTER (p_size % 3 = 0) AS complete, count(*) FILTER (p_size % 3 = 1) AS failed, count(*) FILTER (p_size % 3 = 2) AS missing FROM part GROUP BY 1""")
def run_summary(spark, sf_dir):
    """How many families of each group are done."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), "p_partkey", "p_size")
    return se.status_summary(se.run_status(p, p.where("p_size % 3 = 0"), p.where("p_size % 3 = 1"), "p_partkey"), "grp")


@query("SELECT p_partkey AS family, node, p_size AS change, p_size + CASE node WHEN 'A<1>' THEN 1 ELSE 2 END AS child FROM part CROSS JOIN (VALUES ('A<1>'), ('<2>')) t(node)")
def aligned_nodes(spark, sf_dir):
    """Changes and counts of every family and node; a pair that one of them lacks would be an error."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family"), "p_size", F.explode(F.array(F.lit("A<1>"), F.lit("<2>"))).alias("node"))
    change = p.select("family", "node", F.col("p_size").alias("change"))
    count = p.select("family", "node", (F.col("p_size") + F.when(F.col("node") == "A<1>", 1).otherwise(2)).alias("child"))
    return jn.matched(change, count, ["family", "node"])
