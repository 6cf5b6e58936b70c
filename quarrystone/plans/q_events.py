"""Queries of change events: yearly change of a part's copies in a region."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.functions.stats import benjamini_hochberg, places
from quarrystone.operators import events as ev
from quarrystone.plans.base import supplied, table
from quarrystone.plans.register import query

#: A year is a node; p of a branch falls with the change, p of a family with its copies: stand-ins in (0, 1].
CHANGES = """
yearly AS (
  SELECT l_partkey AS family, r_name AS species, year(l_shipdate) AS node, count(*) AS child
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3
), changes AS (
  SELECT *, child - coalesce(lag(child) OVER (PARTITION BY family, species ORDER BY node), 0) AS change FROM yearly
), family_p AS (SELECT family, 1.0::DOUBLE / (1 + sum(child) % 97) / (1 + count(*)) AS fp FROM yearly GROUP BY 1),
ranked AS (SELECT *, fp * count(*) OVER () / row_number() OVER (ORDER BY fp) AS raw, row_number() OVER (ORDER BY fp) AS rn FROM family_p),
family_q AS (SELECT family, fp, least(1.0, min(raw) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ranked),
events AS (
  SELECT c.family, c.species, c.node, c.child, c.change, c.child - c.change AS parent, 1.0::DOUBLE / (1 + abs(c.change) * 13 + c.node % 50) AS p, f.q,
         CASE WHEN c.change > 0 THEN 'expansion' ELSE 'contraction' END AS direction, c.species IN ('ASIA', 'EUROPE') AS terminal,
         CASE WHEN c.change > 0 THEN (c.child + 1.0::DOUBLE) / (c.child - c.change + 1) ELSE (c.child - c.change + 1.0::DOUBLE) / (c.child + 1) END AS fold
  FROM changes c JOIN family_q f USING (family) WHERE c.change <> 0
), tiered AS (
  SELECT *, CASE WHEN q <= 0.05 AND p <= 0.01 AND abs(change) >= 2 THEN 'high' WHEN p <= 0.05 THEN 'candidate' ELSE 'supporting' END AS tier,
         round(least(50.0, -log10(greatest(q, 1e-50))) + least(50.0, -log10(greatest(p, 1e-50))) + log2(1 + abs(change)) + log2(greatest(1.0, fold)) + CAST(terminal AS INT), 6) AS score
  FROM events
)"""


def _yearly(spark, sf_dir):
    return supplied(spark, sf_dir).groupBy(F.col("l_partkey").alias("family"), "species", F.year("l_shipdate").alias("node")).agg(F.count("*").alias("child"))


def _family_q(yearly):
    p = 1.0 / (1 + F.sum("child") % 97) / (1 + F.count("*"))
    return benjamini_hochberg(written(yearly.groupBy("family").agg(p.alias("fp")), "family_p"), "fp", "q")


def _events(spark, sf_dir):
    before = F.lag("child").over(Window.partitionBy("family", "species").orderBy("node"))
    yearly = written(_yearly(spark, sf_dir), "yearly")  # read by the events and twice by the families
    changes = yearly.withColumn("change", F.col("child") - F.coalesce(before, F.lit(0)))
    rows = changes.join(_family_q(yearly), "family").withColumns(
        {"p": 1.0 / (1 + F.abs("change") * 13 + F.col("node") % 50), "terminal": F.col("species").isin("ASIA", "EUROPE")}
    )
    found = ev.derive(rows)
    q, p, change = F.col("q"), F.col("p"), F.col("change")
    return found.withColumns({"tier": ev.event_tier(q, p, change), "score": ev.event_score(q, p, change, F.col("fold"), F.col("terminal"))})


@query(f"WITH {CHANGES} SELECT family, species, node, child, change, parent, direction, round(fold, 6) AS fold FROM events")
def change_events(spark, sf_dir):
    return _events(spark, sf_dir).select("family", "species", "node", "child", "change", "parent", "direction", F.round("fold", 6).alias("fold"))


@query(f"WITH {CHANGES} SELECT tier, count(*) AS n, round(sum(score), 3) AS score FROM tiered GROUP BY 1")
def event_tier_score(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))


FAMILIES = f"""{CHANGES},
fam AS (
  SELECT family, min(q) AS q, count(*) FILTER (tier = 'high') AS high_events, count(*) FILTER (tier = 'candidate') AS candidate_events,
         count(*) FILTER (terminal AND direction = 'expansion') AS terminal_expansions, count(*) FILTER (terminal AND direction = 'contraction') AS terminal_contractions,
         max(score) AS score FROM tiered GROUP BY 1
), families AS (
  SELECT family, CASE WHEN high_events > 0 THEN 'high' WHEN q <= 0.05 THEN 'fdr_supported' WHEN candidate_events > 0 THEN 'candidate' ELSE 'family_only' END AS tier,
         q, high_events, candidate_events, terminal_expansions, terminal_contractions, score FROM fam
)"""


@query(f"""WITH {FAMILIES}, o AS (SELECT family, tier, score, high_events, candidate_events, terminal_expansions, terminal_contractions,
row_number() OVER (ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'fdr_supported' THEN 1 WHEN 'candidate' THEN 2 ELSE 3 END, score DESC, family) AS place FROM families)
SELECT * FROM o""")
def family_ranked(spark, sf_dir):
    f = ev.families(_events(spark, sf_dir)).select("family", "tier", "score", "high_events", "candidate_events", "terminal_expansions", "terminal_contractions")
    return places(f, ev.order_of(F.col("tier"), ev.FAMILY_ORDER), F.desc("score"), "family")


@query(f"""WITH {CHANGES} SELECT family, species, node, row_number() OVER (ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'candidate' THEN 1 ELSE 2 END, score DESC, family, node, species) AS place FROM tiered""")
def sorted_events(spark, sf_dir):
    rows = _events(spark, sf_dir).select("family", "species", "node", "tier", "score")
    return places(rows, ev.order_of(F.col("tier"), ev.EVENT_ORDER), F.desc("score"), "family", "node", "species").select("family", "species", "node", "place")


@query(f"""WITH {CHANGES}, b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, node, direction DESC, change DESC) AS rn FROM tiered)
SELECT family, node AS best_node, score FROM b WHERE rn = 1""")
def best_event(spark, sf_dir):
    return ev.families(_events(spark, sf_dir)).select("family", "best_node", "score")


BH = """SELECT {key}, round(least(1.0, min(p * m / rn) OVER ({part} ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 9) AS q
FROM (SELECT *, count(*) OVER ({part}) AS m, row_number() OVER ({part} ORDER BY p) AS rn
      FROM (SELECT o_orderkey, o_orderpriority, 1.0::DOUBLE / (1 + o_totalprice) AS p FROM orders))"""


@query(BH.format(key="o_orderkey", part=""))
def bh_fdr_global(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (1.0 / (1 + F.col("o_totalprice"))).alias("p"))
    return benjamini_hochberg(o, "p", "q").select("o_orderkey", F.round("q", 9).alias("q"))


@query(BH.format(key="o_orderkey, o_orderpriority", part="PARTITION BY o_orderpriority"))
def bh_fdr_by_stratum(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (1.0 / (1 + F.col("o_totalprice"))).alias("p"))
    return benjamini_hochberg(o, "p", "q", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", F.round("q", 9).alias("q"))
