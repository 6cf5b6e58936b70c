"""Queries of scores, ranks and scenarios: a part is a family, its type the group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.functions.numbers import clamp, ratio, rounded
from quarrystone.functions.stats import average_ranks as fractional_ranks
from quarrystone.functions.stats import group_places
from quarrystone.operators import joins as jn
from quarrystone.operators import ranking as rk
from quarrystone.operators import scoring as sc
from quarrystone.operators import sensitivity as se
from quarrystone.operators import validation as va
from quarrystone.plans.base import table
from quarrystone.plans.register import query

STAR = """
li AS (SELECT l_partkey AS family, count(*) AS size, count(*) FILTER (l_returnflag = 'N') AS passed, count(*) FILTER (l_returnflag = 'R') AS reviewed,
       count(*) FILTER (l_discount > 0.08) AS excluded, count(*) FILTER (l_tax > 0.07) AS flags, round(avg(l_discount) * 10, 6) AS pfam, count(*) FILTER (l_quantity > 45) AS strong, count(*) FILTER (l_linenumber = 4) AS lost FROM lineitem GROUP BY 1),
od AS (SELECT l_partkey AS family, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS orders, min(o_totalprice) AS cheapest FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
ex AS (SELECT user_id AS family, count(*) AS copies, count(*) FILTER (value >= 10) AS detected, max(value) AS most FROM events GROUP BY 1),
st AS (
  SELECT p_partkey AS family, p_type AS grp, coalesce(size, 0) AS size, coalesce(passed, 0) AS passed, coalesce(reviewed, 0) AS reviewed, coalesce(excluded, 0) AS excluded, coalesce(flags, 0) AS flags,
         coalesce(pfam, 0.0) AS pfam, p_size, CASE WHEN p_size % 3 > 0 THEN 6 ELSE 0 END + CASE WHEN p_size % 4 = 0 THEN 4 WHEN p_size % 4 = 1 THEN 2 ELSE 0 END + 0.0::DOUBLE AS tree,
         CASE WHEN size IS NULL THEN 0.0 ELSE 4 + 3 * least(1.0::DOUBLE, (passed + reviewed) / size::DOUBLE) + CASE WHEN (p_size % 2 = 0 AND strong > 0) OR (p_size % 2 = 1 AND lost > 0) THEN 3 ELSE 0 END END AS reconciliation, 25 * greatest(1.0::DOUBLE / 30, (31 - least(p_size, 30)) / 30.0::DOUBLE) AS change,
         4 * (p_size / 50.0::DOUBLE) + CASE WHEN contains(p_name, 'red') THEN 2 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END AS annotation,
         CASE WHEN orders IS NOT NULL THEN CASE WHEN cheapest < 5000 THEN 8 ELSE 0 END + CASE WHEN done > 0 THEN 6 ELSE 0 END + 0.0::DOUBLE END AS evolution,
         CASE WHEN copies IS NOT NULL THEN 3 * (detected / copies::DOUBLE) + CASE WHEN most >= 10 THEN 2.0 WHEN most >= 1 THEN 1.5 WHEN most >= 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE END AS expression
  FROM part LEFT JOIN li ON li.family = p_partkey LEFT JOIN od ON od.family = p_partkey LEFT JOIN ex ON ex.family = p_partkey
), cp AS (
  SELECT *, CASE WHEN size = 0 THEN 0.0 ELSE least(1.0::DOUBLE, (passed + reviewed) / size::DOUBLE) END AS ok FROM st
), sq AS (
  SELECT *, 8 * ok + 4 * CASE WHEN size = 0 THEN 0.0 ELSE passed / size::DOUBLE END + 3 * least(1.0::DOUBLE, pfam) + 5 * (1 - CASE WHEN size = 0 THEN 0.0 ELSE flags / size::DOUBLE END) AS sequence,
         CASE WHEN size = 0 THEN false ELSE excluded / size::DOUBLE > 0.25 OR flags / size::DOUBLE > 0.5 END AS critical FROM cp
), scored AS (
  SELECT *, round(100 * (change + annotation + sequence + tree + reconciliation + coalesce(evolution, 0) + coalesce(expression, 0)) / (75 + CASE WHEN evolution IS NULL THEN 0 ELSE 20 END + CASE WHEN expression IS NULL THEN 0 ELSE 5 END), 3) AS base,
         4 + CASE WHEN annotation > 0 THEN 1 ELSE 0 END + CASE WHEN evolution IS NULL THEN 0 ELSE 1 END + CASE WHEN expression IS NULL THEN 0 ELSE 1 END AS domains FROM sq
), tiered AS (
  SELECT *, CASE WHEN critical THEN 'manual_review_required' WHEN base >= 75 AND domains >= 6 AND ok >= 0.5 THEN 'tier1_high_confidence' WHEN base >= 60 AND domains >= 5 AND ok >= 0.35 THEN 'tier2_supported'
                 WHEN base >= 45 AND domains >= 4 THEN 'tier3_provisional' ELSE 'lower_priority' END AS base_tier,
         row_number() OVER (PARTITION BY grp ORDER BY base DESC, family) AS base_rank FROM scored
)"""


def _families(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family"), F.col("p_type").alias("grp"), "p_name", "p_size", "p_brand")
    lines = table(spark, sf_dir, "lineitem")
    li = lines.groupBy(F.col("l_partkey").alias("family")).agg(
        F.count("*").alias("size"), F.count_if(F.col("l_returnflag") == "N").alias("passed"), F.count_if(F.col("l_returnflag") == "R").alias("reviewed"),
        F.count_if(F.col("l_discount") > 0.08).alias("excluded"), F.count_if(F.col("l_tax") > 0.07).alias("flags"), rounded(F.avg("l_discount") * 10, 6).alias("pfam"),
        F.count_if(F.col("l_quantity") > 45).alias("strong"), F.count_if(F.col("l_linenumber") == 4).alias("lost"), F.lit(True).alias("reconciled"),
    )
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    od = lines.join(o, lines.l_orderkey == o.o_orderkey).groupBy(F.col("l_partkey").alias("family")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("orders"), F.min("o_totalprice").alias("cheapest")
    )
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("family")).agg(F.count("*").alias("copies"), F.count_if(F.col("value") >= 10).alias("detected"), F.max("value").alias("most"))
    rows = sc.star(p, [(li, ["family"]), (od, ["family"]), (e, ["family"])]).na.fill(0, ["size", "passed", "reviewed", "excluded", "flags", "pfam"])
    c = F.col
    name = c("p_name")
    parts = {
        "change": sc.change_component(F.least(c("p_size"), F.lit(30))),
        "annotation": sc.annotation_component(c("p_size") / 50.0, (F.contains(name, F.lit("red")), 2), (F.contains(name, F.lit("ring")), 1)),
        "sequence": sc.sequence_component(c("passed"), c("reviewed"), c("size"), c("pfam"), ratio(c("flags"), c("size"))),
        "tree": sc.tree_component(c("p_size") % 3 > 0, F.when(c("p_size") % 4 == 0, "ufboot1000_alrt1000").when(c("p_size") % 4 == 1, "alrt1000").otherwise("")),
        "reconciliation": sc.reconciliation_component(c("reconciled").isNotNull(), c("passed") + c("reviewed"), c("size"), F.when(c("p_size") % 2 == 0, c("strong") > 0).otherwise(c("lost") > 0)),
        "evolution": sc.evolution_component(c("orders").isNotNull(), F.when(c("cheapest") < 5000, 0.0), c("done"), F.lit(None).cast("double")),
        "expression": sc.expression_component(c("copies").isNotNull(), c("detected"), c("copies"), c("most")),
    }
    rows = rows.withColumns(parts)
    rows = rows.withColumns({
        "ok": F.least(F.lit(1.0), ratio(c("passed") + c("reviewed"), c("size"))),
        "critical": sc.risk_gate(c("excluded"), c("flags"), c("size")),
        "base": rounded(sc.available_score({n: c(n) for n in parts}, sc.MAXIMA), 3),
        "domains": sc.domain_count(c("annotation"), c("evolution"), c("expression")),
    })
    rows = rows.withColumn("base_tier", sc.family_tier(c("base"), c("domains"), c("critical"), c("ok")))
    # A row per family, read by many queries' parts: written once, ranked within its group.
    return written(group_places(rows, ["grp"], F.desc("base"), "family", out="base_rank"), "scored")


@query(f"WITH {STAR} SELECT family, grp, base, domains, critical FROM tiered")
def star_join_score(spark, sf_dir):
    return _families(spark, sf_dir).select("family", "grp", "base", "domains", "critical")


@query(f"WITH {STAR} SELECT grp, base_tier, count(*) AS families FROM tiered GROUP BY 1, 2")
def family_tiers(spark, sf_dir):
    return _families(spark, sf_dir).groupBy("grp", "base_tier").agg(F.count("*").alias("families"))


@query(f"WITH {STAR} SELECT family, grp, row_number() OVER (ORDER BY base DESC, grp, family) AS overall_rank, row_number() OVER (PARTITION BY grp ORDER BY base DESC, grp, family) AS group_rank FROM tiered")
def family_ranks(spark, sf_dir):
    return rk.global_and_group_rank(_families(spark, sf_dir), ["grp"], F.desc("base"), F.col("grp"), F.col("family")).select("family", "grp", "overall_rank", "group_rank")


GENES = f"""{STAR}, genes AS (
  SELECT t.family, grp, l_orderkey AS gene, l_linenumber AS copy, base, critical, CASE l_returnflag WHEN 'N' THEN 'pass' WHEN 'A' THEN 'review' ELSE 'review_high' END AS status, most AS tpm
  FROM tiered t JOIN lineitem ON l_partkey = t.family LEFT JOIN ex USING (family) WHERE base_rank <= 10
), gs AS (SELECT *, round(100 * (0.7 * base + CASE status WHEN 'pass' THEN 20 WHEN 'review' THEN 14 ELSE 6 END + CASE WHEN tpm IS NULL THEN 0 WHEN tpm >= 10 THEN 10 WHEN tpm >= 1 THEN 8 WHEN tpm >= 0.1 THEN 5 WHEN tpm > 0 THEN 2 ELSE 0 END)
  / (90 + CASE WHEN tpm IS NULL THEN 0 ELSE 10 END), 3) AS score FROM genes)"""


@query(f"""WITH {GENES} SELECT family, gene, copy, score, CASE WHEN critical THEN 'manual_review_or_exclude' WHEN score >= 75 AND status = 'pass' THEN 'tier1_high_confidence' WHEN score >= 60 AND status IN ('pass', 'review') THEN 'tier2_supported'
WHEN score >= 45 THEN 'tier3_provisional' ELSE 'lower_priority' END AS tier, row_number() OVER (PARTITION BY grp ORDER BY score DESC, family, gene, copy) AS place, row_number() OVER (ORDER BY score DESC, grp, family, gene, copy) AS overall FROM gs""")
def gene_rank(spark, sf_dir):
    top = _families(spark, sf_dir).where("base_rank <= 10").select("family", "grp", "base", "critical", F.col("most").alias("tpm"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("family"), F.col("l_orderkey").alias("gene"), F.col("l_linenumber").alias("copy"), "l_returnflag")
    status = F.when(F.col("l_returnflag") == "N", "pass").when(F.col("l_returnflag") == "A", "review").otherwise("review_high")
    g = li.join(top, "family").withColumn("status", status).withColumn("score", rounded(sc.gene_score(F.col("base"), F.col("status"), F.col("tpm")), 3))
    g = g.withColumn("tier", sc.gene_tier(F.col("score"), F.col("status"), F.col("critical")))
    ranked = rk.global_and_group_rank(g.select("family", "grp", "gene", "copy", "score", "tier"), ["grp"], F.desc("score"), F.col("grp"), F.col("family"), F.col("gene"), F.col("copy"))
    return ranked.select("family", "gene", "copy", "score", "tier", F.col("group_rank").alias("place"), F.col("overall_rank").alias("overall"))


def ranked_families(spark, sf_dir):
    c, most = F.col, sc.MAXIMA
    f = _families(spark, sf_dir).withColumns({n: c(n) / most[n] for n in most})
    f = f.withColumns({
        "acceptable": c("ok"), "passed": ratio(c("passed"), c("size")), "high_risk": ratio(c("flags"), c("size")),
        "excluded": ratio(c("excluded"), c("size")), "pfam": clamp(c("pfam")), "annotation_share": c("p_size") / 50.0,
    })
    # The proteome of a family's event is that of its brand, if the node names one; the brands with an even number have no report.
    k = F.regexp_extract("species", "([0-9]+)$", 1).try_cast("int")
    brands = table(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.col("p_brand").alias("species")).distinct()
    reports = brands.select("species").distinct().where(k % 2 == 1).select("species", (90.0 + k).alias("complete"), (k * 2.0).alias("duplicated"))
    node = F.when(c("p_size") % 2 == 0, F.concat("p_brand", F.lit("<"), c("p_size").cast("string"), F.lit(">"))).otherwise("<1>")
    return se.rankings(se.proteome_quality(f.withColumn("node", node), "node", reports, brands))


_W = {n: m for n, m in sc.MAXIMA.items()}
_R = {n: f"least(1.0, greatest(0.0, {n} / {m}))" if n not in ("evolution", "expression") else f"CASE WHEN {n} IS NOT NULL THEN least(1.0, greatest(0.0, {n} / {m})) END" for n, m in sc.MAXIMA.items()}


def _weighted(ratios, weights):
    got = " + ".join(f"coalesce({ratios[n]}, 0) * {w}" for n, w in weights.items())
    most = " + ".join(f"CASE WHEN {ratios[n]} IS NULL THEN 0.0 ELSE {w} END" for n, w in weights.items())
    return f"100 * ({got}) / ({most})"


_SHARE = lambda x: f"CASE WHEN size = 0 THEN 0.0 ELSE {x} / size::DOUBLE END"
_STRICT = f"greatest(0.0, least(1.0, 0.5 * ok + 0.3 * {_SHARE('passed')} + 0.2 * least(1.0, pfam) - 0.5 * {_SHARE('flags')} - 0.5 * {_SHARE('excluded')}))"
_SCENES = {
    "baseline": ("base", "true"),
    **{n: (_weighted(_R, {k: v for k, v in _W.items() if k != p}), "true") for n, p in se.WITHOUT.items()},
    **{n: (_weighted(_R, w), "true") for n, w in se.OWN_WEIGHTS.items()},
    "strict_sequence_quality": (_weighted(_R | {"sequence": _STRICT}, _W), f"ok >= 0.75 AND excluded = 0 AND {_SHARE('flags')} <= 0.1"),
    "strict_contamination_risk": ("base", "flags = 0"),
    "complete_case_only": ("base", "domains >= 7"),
    "eggnog_annotation_only": (_weighted(_R | {"annotation": "(t.p_size / 50.0::DOUBLE)"}, _W), "true"),
    "direct_pfam_annotation_only": (_weighted(_R | {"annotation": "least(1.0, pfam)"}, _W), "true"),
    "proteome_quality_adjusted": (_weighted(_R | {"change": f"(coalesce({_R['change']}, 0) * quality)"}, _W), "true"),
}
QUALITY = """reports AS (SELECT DISTINCT p_brand AS species, 90.0::DOUBLE + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS complete, 2.0::DOUBLE * CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS duplicated
FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 2 = 1),
means AS (SELECT p_type, avg(complete) AS c, avg(duplicated) AS d FROM (SELECT DISTINCT p_type, p_brand FROM part) JOIN reports ON p_brand = species GROUP BY 1),
quality AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND species IS NOT NULL THEN species ELSE 'group_mean' END AS event, CASE WHEN p_size % 2 = 0 AND species IS NOT NULL THEN complete ELSE c END AS complete, CASE WHEN p_size % 2 = 0 AND species IS NOT NULL THEN duplicated ELSE d END AS duplicated FROM part LEFT JOIN reports ON species = p_brand LEFT JOIN means USING (p_type)),
factors AS (SELECT p_partkey, event, complete, duplicated, least(1.0, greatest(0.0, complete / 100)) * greatest(0.0, 1 - duplicated / 100) AS quality FROM quality)"""
RANKED = f"""{STAR}, {QUALITY}, long AS ({" UNION ALL ".join(f"SELECT '{n}' AS scenario, grp, t.family, base, base_rank, base_tier, domains, CAST(round(CAST({s} AS DECIMAL(24,12)), 6) AS DOUBLE) AS score, NOT critical AND ({e}) AS eligible FROM tiered t JOIN factors ON p_partkey = t.family" for n, (s, e) in _SCENES.items())}),
ranked AS (SELECT *, CASE WHEN scenario = 'baseline' THEN base_rank ELSE row_number() OVER (PARTITION BY scenario, grp ORDER BY eligible DESC, score DESC, family) END AS rank FROM long),
shifted AS (SELECT *, base_rank - rank AS shift, CASE WHEN scenario = 'baseline' THEN base_tier WHEN NOT eligible THEN 'manual_review_or_filtered' WHEN score >= 75 AND domains >= 6 THEN 'tier1_high_confidence'
WHEN score >= 60 AND domains >= 5 THEN 'tier2_supported' WHEN score >= 45 AND domains >= 4 THEN 'tier3_exploratory' ELSE 'lower_priority' END AS tier FROM ranked)"""


@query(f"WITH {RANKED} SELECT scenario, s.grp, s.family, score, eligible, tier, CASE {" ".join(f"WHEN scenario = '{n}' THEN '{t}'" for n, t in se.NOTES.items())} ELSE format('event_species={{}};C={{:.1f}};D={{:.1f}};factor={{:.4f}}', event, complete, duplicated, quality) END AS note FROM shifted s JOIN factors ON p_partkey = s.family")
def scenario_scores(spark, sf_dir):
    return ranked_families(spark, sf_dir).select("scenario", "grp", "family", "score", "eligible", "tier", "note")


@query(f"""WITH {RANKED} SELECT scenario, grp, round(corr(base_rank, rank), 6) AS rho, max(abs(shift)) AS largest_shift FROM shifted GROUP BY 1, 2""")
def scenario_spearman(spark, sf_dir):
    return se.comparison(ranked_families(spark, sf_dir)).select("scenario", "grp", "rho", "largest_shift")


_NOW = lambda k: f"rank <= {k} AND (eligible OR scenario = 'baseline')"


@query(f"""WITH {RANKED} SELECT scenario, grp, count(*) FILTER (eligible) AS eligible, {", ".join(f"count(*) FILTER (base_rank <= {k} AND {_NOW(k)}) AS top{k}_overlap, round(count(*) FILTER (base_rank <= {k} AND {_NOW(k)}) / greatest(1, count(*) FILTER (base_rank <= {k} OR ({_NOW(k)})))::DOUBLE, 6) AS top{k}_jaccard" for k in (10, 20))},
count(*) FILTER (base_tier = 'tier1_high_confidence' AND tier = 'tier1_high_confidence') AS tier1_retained FROM shifted GROUP BY 1, 2""")
def topk_overlap(spark, sf_dir):
    return se.comparison(ranked_families(spark, sf_dir)).select("scenario", "grp", "eligible", "top10_overlap", "top10_jaccard", "top20_overlap", "top20_jaccard", "tier1_retained")


@query(f"""WITH {RANKED}, g AS (SELECT grp, family, round(avg(rank), 3) AS mean_rank, round(stddev_pop(rank), 3) AS rank_sd, min(rank) AS best_rank, max(rank) AS worst_rank, max(abs(shift)) AS largest_shift,
count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND rank <= 10) AS top10, count(*) FILTER (eligible AND rank <= 20) AS top20 FROM shifted GROUP BY 1, 2)
SELECT *, CASE WHEN top10 >= 11 AND largest_shift <= 5 THEN 'stable_high' WHEN largest_shift >= 10 OR eligible < 11 THEN 'sensitive' ELSE 'moderately_stable' END AS stability FROM g""")
def rank_stability(spark, sf_dir):
    return se.stability(ranked_families(spark, sf_dir))


@query(f"""WITH {STAR}, x AS (SELECT grp, family, domains >= 6 AS matched, base AS value, base_rank, t AS threshold FROM tiered CROSS JOIN (SELECT unnest([40, 50, 60]) AS t))
SELECT grp, threshold, count(*) AS families, count(*) FILTER (matched) AS matched, count(*) FILTER (matched AND value < threshold) AS below, count(*) FILTER (matched AND value < threshold AND base_rank <= 10) AS top10_below,
coalesce(string_agg(family, ',' ORDER BY family) FILTER (matched AND value < threshold), 'none') AS below_families FROM x GROUP BY 1, 2""")
def threshold_sensitivity(spark, sf_dir):
    f = _families(spark, sf_dir).select("grp", "family", (F.col("domains") >= 6).alias("matched"), F.col("base").alias("value"), "base_rank")
    return se.threshold_report(f, (40, 50, 60))


@query(f"WITH {STAR} SELECT grp, t AS threshold, family, base_rank FROM tiered CROSS JOIN (SELECT unnest([40, 50, 60]) AS t) WHERE domains >= 6 AND base < t")
def threshold_families(spark, sf_dir):
    """The matched families below each threshold."""
    f = _families(spark, sf_dir).select("grp", "family", (F.col("domains") >= 6).alias("matched"), F.col("base").alias("value"), "base_rank")
    return se.threshold_members(f, (40, 50, 60))


@query(f"""WITH {STAR} SELECT grp, count(*) AS families, round(avg(base), 4) AS mean_score, max(base) AS best_score, count(*) FILTER (base_tier = 'tier1_high_confidence') AS tier1, count(*) FILTER (base_tier = 'tier2_supported') AS tier2,
count(*) FILTER (base_tier = 'tier3_provisional') AS tier3, count(*) FILTER (critical) AS critical, count(*) FILTER (evolution IS NOT NULL) AS with_evolution, count(*) FILTER (expression IS NOT NULL) AS with_expression FROM tiered GROUP BY 1""")
def group_scores(spark, sf_dir):
    """A row per group of what its families' scores come to."""
    return sc.group_summary(_families(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 4))


@query("""WITH v AS (SELECT source AS species, doc_id AS gene, quality FROM documents JOIN labels USING (doc_id)), q AS (SELECT user_id AS gene, max(value) AS tpm FROM events GROUP BY 1), e AS (SELECT p_brand AS grp, p_type AS family, min(p_size) / 100.0::DOUBLE AS q_bh FROM part WHERE p_size > 10 GROUP BY 1, 2)
SELECT p_partkey AS gene, coalesce(tpm, -1.0) AS tpm, CASE WHEN tpm IS NULL THEN 'not_quantified' WHEN tpm = 0 THEN 'undetected' WHEN tpm < 0.1 THEN 'trace' WHEN tpm < 1 THEN 'low' WHEN tpm < 10 THEN 'moderate' ELSE 'high' END AS expression,
coalesce(CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'review' END, '') AS status, coalesce(q_bh, -1.0) AS q_bh
FROM part LEFT JOIN q ON q.gene = p_partkey LEFT JOIN v ON v.gene = p_partkey AND v.species = 'src' || (p_partkey % 20) LEFT JOIN e ON grp = p_brand AND family = p_type""")
def candidate_expression(spark, sf_dir):
    """Candidates with their quantity, the check of their sequence and their family's test, each by its own keys."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.concat(F.lit("src"), F.col("p_partkey") % 20).alias("species"), F.col("p_brand").alias("grp"), F.col("p_type").alias("family"))
    quant = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("gene")).agg(F.max("value").alias("tpm"))
    valid = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("species"), F.col("doc_id").alias("gene"), F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "review").alias("status"))
    tests = table(spark, sf_dir, "part").where("p_size > 10").groupBy(F.col("p_brand").alias("grp"), F.col("p_type").alias("family")).agg((F.min("p_size") / 100.0).alias("q_bh"))
    rows = sc.star(p, [(quant, ["gene"]), (valid, ["species", "gene"]), (tests, ["grp", "family"])])
    bins = F.when(F.col("tpm").isNull(), "not_quantified").otherwise(va.expression_bin(F.col("tpm")))
    return rows.select("gene", F.coalesce("tpm", F.lit(-1.0)).alias("tpm"), bins.alias("expression"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("q_bh", F.lit(-1.0)).alias("q_bh"))


@query("""SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 10""")
def top10_per_group(spark, sf_dir):
    return rk.top_per(table(spark, sf_dir, "orders"), ["o_orderpriority"], 10, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderpriority", "o_orderkey", "place")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 6) AS share FROM customer GROUP BY 1")
def ratio_to_group(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    return g.select("c_mktsegment", "n", F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("share"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS place FROM part")
def average_ranks(spark, sf_dir):
    return fractional_ranks(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "place").select("p_partkey", "place")


@query("""SELECT 'union_all' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union_all": a.unionByName(b), "union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b).distinct().join(b, "k", "left_anti")}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT 'semi' AS op, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'unknown', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def semi_anti_checks(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    keys = o.select(F.col("o_custkey").alias("c_custkey"))
    counts = {"semi": c.join(keys, "c_custkey", "left_semi"), "anti": jn.missing_keys(c, keys, ["c_custkey"]), "unknown": jn.missing_keys(keys, c, ["c_custkey"])}
    out = None
    for name, df in counts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_first, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_second FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders) ON a = b""")
def key_sets_equal(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return jn.same_keys(table(spark, sf_dir, "customer"), o, ["c_custkey"])


@query("""WITH n AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '<' || p_size || '>' ELSE '' END AS node FROM part), q AS (SELECT DISTINCT p_name AS pre FROM part WHERE p_size > 45)
SELECT p_partkey, node, max(pre) AS pre FROM n LEFT JOIN q ON node = pre OR starts_with(node, pre || '<') GROUP BY 1, 2""")
def prefix_longest_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    node = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("<"), F.col("p_size").cast("string"), F.lit(">"))).otherwise(F.col("p_name"))
    known = p.where("p_size > 45").select(F.col("p_name").alias("pre")).distinct()
    return jn.longest_prefix(p.select("p_partkey", node.alias("node")), "node", known, "pre").select("p_partkey", "node", "pre")
