"""Queries of checked sequences, ordered reports and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.functions import arrays as arr
from quarrystone.functions import stats as st
from quarrystone.operators import annotation as an
from quarrystone.operators import joins as jn
from quarrystone.operators import occupancy as oc
from quarrystone.operators import quality as qu
from quarrystone.operators import ranking as rk
from quarrystone.operators import sinks
from quarrystone.operators import trees as tr
from quarrystone.operators import validation as va
from quarrystone.plans import q_ranking, q_terms
from quarrystone.plans.base import REGIONS, copies, table
from quarrystone.plans.q_sequences import LETTERS
from quarrystone.plans.register import query

#: A document as a sequence: letters of its text in upper case, with a stop or a foreign sign in some.
CHECKED = """
seqs AS (SELECT doc_id AS item, lang AS family, source AS species, substr(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1, CASE WHEN doc_id % 11 = 0 THEN 20 + doc_id % 100 ELSE 1000000000 END)
         || CASE WHEN doc_id % 13 = 0 THEN '*' WHEN doc_id % 17 = 0 THEN '*A' WHEN doc_id % 19 = 0 THEN '#' ELSE '' END AS seq,
         CASE WHEN doc_id % 23 = 0 THEN 'a chloroplast, light harvest' WHEN doc_id % 29 = 0 THEN 'Phage Capsid' WHEN doc_id % 31 = 0 THEN 'gag-pol DDE_Tnp' ELSE 'kinase' END AS text,
         CASE WHEN doc_id % 37 = 0 THEN 'GO:0000001,GO:0015979' ELSE '' END AS go, list_extract(['metazoa', 'metazoa', 'metazoa', 'unassigned', 'bacteria', 'fungi', 'unknown'], CAST(doc_id % 7 + 1 AS BIGINT)) AS lineage FROM documents),
hits AS (SELECT DISTINCT doc_id AS item, lang AS family, 'T' || ((doc_id * 7 + i) % 3 + CASE WHEN doc_id % 41 = 0 THEN 50 ELSE 0 END) AS term FROM documents, range(0, 2) r(i) WHERE doc_id % 9 <> 0),
fam AS (SELECT family, median(length(seq)) AS med, count(*) AS n FROM seqs GROUP BY 1), wd AS (SELECT family, count(DISTINCT item) AS k FROM hits GROUP BY 1),
core AS (SELECT h.family, term FROM hits h JOIN wd USING (family) WHERE k >= 3 GROUP BY h.family, term, k HAVING count(DISTINCT item) >= greatest(2, ceil(0.6 * k))),
cores AS (SELECT family, list(term) AS core FROM core GROUP BY 1), ih AS (SELECT item, list(term) AS terms FROM hits GROUP BY 1),
dg AS (SELECT md5(seq) AS digest, count(*) AS c, CASE WHEN count(DISTINCT family) > 1 THEN 'cross_orthogroup' WHEN count(DISTINCT species) = 1 THEN 'within_species_family' ELSE 'cross_species_family' END AS context FROM seqs GROUP BY 1 HAVING count(*) > 1),
chars AS (SELECT item, sum(-p * log2(p)) AS bits FROM (SELECT item, x, length(seq) - length(replace(seq, x, '')) AS n, (length(seq) - length(replace(seq, x, ''))) / sum(length(seq) - length(replace(seq, x, ''))) OVER (PARTITION BY item)::DOUBLE AS p
          FROM seqs, (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWYBXZJUO', '')) AS x)) WHERE n > 0 GROUP BY 1),
base AS (SELECT s.*, length(seq) AS len, length(seq) / med AS ratio, n, coalesce(k, 0) AS k, coalesce(core, []) AS core, coalesce(terms, []) AS terms, context, coalesce(bits, 0.0) AS bits,
         list_sort(list_filter([CASE WHEN regexp_matches(s.text, '(?i)chloroplast|light[- ]harvest') OR contains(go, 'GO:0015979') THEN 'plastid_or_photosynthesis' END, CASE WHEN regexp_matches(s.text, '(?i)gag[- ]?pol') THEN 'transposable_element' END,
           CASE WHEN regexp_matches(s.text, '(?i)capsid') THEN 'viral_or_phage' END], lambda x: x IS NOT NULL)) AS risks
  FROM seqs s JOIN fam USING (family) LEFT JOIN wd USING (family) LEFT JOIN cores USING (family) LEFT JOIN ih USING (item) LEFT JOIN dg ON digest = md5(seq) LEFT JOIN chars USING (item)),
flagged AS (SELECT *, list_concat(list_filter([
  CASE WHEN len < 30 THEN 'very_short_lt30aa:3' WHEN len < 50 THEN 'short_lt50aa:2' WHEN len < 100 THEN 'short_lt100aa:1' END, CASE WHEN contains(seq, '#') THEN 'invalid_amino_acid_characters:3' END,
  CASE WHEN contains(substr(seq, 1, len - 1), '*') THEN 'internal_stop_codon:3' END, CASE WHEN ends_with(seq, '*') THEN 'terminal_stop_symbol:1' END,
  CASE WHEN (CASE WHEN len = 0 THEN 1.0 ELSE (len - length(regexp_replace(seq, '[XBZJ]', '', 'g'))) / len::DOUBLE END) > 0.05 THEN 'ambiguous_residue_fraction_gt5pct:1' END, CASE WHEN bits < 2 AND len >= 50 THEN 'low_sequence_complexity:1' END,
  CASE WHEN n >= 5 AND ratio < 0.5 THEN 'severe_short_length_outlier:2' WHEN n >= 5 AND ratio < 0.67 THEN 'moderate_short_length_outlier:1' END, CASE WHEN n >= 5 AND ratio > 2 THEN 'severe_long_length_outlier:1' END,
  CASE WHEN context = 'cross_orthogroup' THEN 'exact_duplicate_cross_orthogroup:2' WHEN context IS NOT NULL THEN 'exact_duplicate_' || context || ':1' END,
  CASE WHEN k >= 3 AND k / n::DOUBLE >= 0.7 AND len(terms) = 0 THEN 'missing_domain_in_domain_rich_family:1' END,
  CASE WHEN len(core) > 0 AND len(terms) > 0 AND len(list_intersect(core, terms)) / len(list_distinct(list_concat(core, terms)))::DOUBLE < 0.25 THEN 'direct_domain_architecture_outlier:1' END,
  CASE WHEN lineage IN ('bacteria', 'archaea', 'virus') THEN 'seed_taxonomy_' || lineage || ':3' WHEN lineage IN ('fungi', 'viridiplantae', 'alveolata', 'stramenopiles', 'other_eukaryote') THEN 'non_metazoan_seed_' || lineage || ':2' END
  ], lambda x: x IS NOT NULL), list_transform(risks, lambda r: 'functional_risk_' || r || ':2')) AS flags FROM base),
checked AS (SELECT item, family, species, lineage, risks, list_transform(flags, lambda f: split_part(f, ':', 1)) AS flags, list_extract(['pass', 'review', 'review_high', 'exclude_recommended'], 1 + coalesce(list_max(list_transform(flags, lambda f: CAST(split_part(f, ':', 2) AS BIGINT))), 0)) AS status FROM flagged)"""


def _checked(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    cut = F.when(k % 11 == 0, F.substring(letters, F.lit(1), (20 + k % 100).cast("int"))).otherwise(letters)
    end = F.when(k % 13 == 0, "*").when(k % 17 == 0, "*A").when(k % 19 == 0, "#").otherwise("")
    text = F.when(k % 23 == 0, "a chloroplast, light harvest").when(k % 29 == 0, "Phage Capsid").when(k % 31 == 0, "gag-pol DDE_Tnp").otherwise("kinase")
    tracks = F.array(*map(F.lit, ("metazoa", "metazoa", "metazoa", "unassigned", "bacteria", "fungi", "unknown")))
    rows = d.select(k.alias("item"), F.col("lang").alias("family"), F.col("source").alias("species"), F.concat(cut, end).alias("seq"), text.alias("text"), F.when(k % 37 == 0, "GO:0000001,GO:0015979").otherwise("").alias("go"), F.get(tracks, (k % 7).cast("int")).alias("lineage"))
    term = lambda i: F.concat(F.lit("T"), ((k * 7 + i) % 3 + F.when(k % 41 == 0, 50).otherwise(0)).cast("string"))
    # All that is asked of the letters, in one pass; what is joined and ranked is this narrow table.
    known = {"digest": F.md5("seq"), "bits": F.coalesce(va.entropy(F.col("seq"), LETTERS.upper()), F.lit(0.0)), "risks": qu.risk_categories(F.col("text"), F.col("go"))}
    rows = written(rows.select("item", "family", "species", "lineage", *[c.alias(n) for n, c in (qu.marks(F.col("seq")) | known).items()]), "marks")
    hits = d.where(k % 9 != 0).select(k.alias("item"), F.col("lang").alias("family"), F.explode(F.array(term(0), term(1))).alias("term")).distinct()
    # A row per family, written: its size is known when the join is planned, so few families make no large tasks.
    domains = written(qu.domain_stats(rows.select("family", "item"), hits).drop("family_size").join(an.core_terms(hits), "family", "left"), "domains")
    own = hits.groupBy("item").agg(F.collect_list("term").alias("terms"))
    full = qu.with_duplicates(va.with_length_ratio(rows, "family", "length")).join(domains, "family", "left").join(own, "item", "left")
    none = F.array().cast("array<string>")
    full = full.withColumns({"core": F.coalesce("core", none), "terms": F.coalesce("terms", none)})
    full = full.withColumns({"n_hits": F.size("terms"), "n_core": F.size("core"), "core_jaccard": arr.jaccard(F.col("core"), F.col("terms"))})
    return qu.validated(full)


@query(f"WITH {CHECKED} SELECT item, family, species, status, array_to_string(flags, ';') AS flags, array_to_string(risks, ';') AS risks FROM checked")
def sequence_validation(spark, sf_dir):
    """All flags of sequences with their worst severity."""
    return _checked(spark, sf_dir).select("item", "family", "species", "status", F.array_join("flags", ";").alias("flags"), F.array_join("risks", ";").alias("risks"))


@query(f"""WITH {CHECKED} SELECT item, status, row_number() OVER (ORDER BY CASE status WHEN 'exclude_recommended' THEN 0 WHEN 'review_high' THEN 1 WHEN 'review' THEN 2 ELSE 3 END, family, species, item) AS place FROM checked
WHERE status IN ('review_high', 'exclude_recommended') OR len(risks) > 0 OR lineage NOT IN ('metazoa', 'unassigned')""")
def sorted_risks(spark, sf_dir):
    """Doubtful sequences, the worst first."""
    worst = F.array_position(F.array(*map(F.lit, va.SEVERITY)), F.col("status"))
    return st.places(qu.high_risk(_checked(spark, sf_dir)).select("item", "status", "family", "species"), worst.desc(), "family", "species", "item").select("item", "status", "place")


@query(f"""WITH {CHECKED}, r AS (SELECT family, count(*) FILTER (status = 'pass') AS pass_sequences, count(*) FILTER (status = 'review') AS review_sequences, count(*) FILTER (status = 'review_high') AS review_high_sequences, count(*) FILTER (status = 'exclude_recommended') AS exclude_sequences,
count(*) FILTER (list_contains(flags, 'direct_domain_architecture_outlier')) AS outliers, count(*) FILTER (list_contains(risks, 'plastid_or_photosynthesis')) AS plastid_or_photosynthesis_flags, count(*) FILTER (list_contains(risks, 'transposable_element')) AS transposable_element_flags,
count(*) FILTER (list_contains(risks, 'viral_or_phage')) AS viral_or_phage_flags, count(*) FILTER (lineage = 'metazoa') AS metazoan, count(*) FILTER (lineage NOT IN ('metazoa', 'unassigned')) AS non_metazoan FROM checked GROUP BY 1), p AS (SELECT *, 100 * exclude_sequences + 10 * review_high_sequences + review_sequences AS priority FROM r)
SELECT *, row_number() OVER (ORDER BY priority DESC, family) AS place FROM p""")
def family_review(spark, sf_dir):
    return st.places(qu.family_review(_checked(spark, sf_dir)), F.desc("priority"), "family")


@query(f"WITH {CHECKED} SELECT family, count(*) AS n FROM checked WHERE status IN ('pass', 'review') GROUP BY 1")
def strict_sequences(spark, sf_dir):
    return qu.strict(_checked(spark, sf_dir)).groupBy("family").agg(F.count("*").alias("n"))


@query(f"""WITH {CHECKED}, s AS (SELECT c.*, length(seq) AS len, len(coalesce(terms, [])) AS t, med FROM checked c JOIN seqs USING (item, family, species) JOIN fam USING (family) LEFT JOIN ih USING (item))
SELECT species, family, item, row_number() OVER (PARTITION BY species, family ORDER BY status <> 'pass', t DESC, abs(len - med), item) AS place FROM s""")
def member_priority(spark, sf_dir):
    """Which of a species' sequences stands for it: a passing one, of more domains, closer to the median, of the smaller id."""
    order = [F.col("status") != "pass", F.desc("n_hits"), F.abs(F.col("length") - F.col("family_median")), F.col("item")]
    checked = _checked(spark, sf_dir).select("species", "family", "item", "status", "n_hits", "length", "family_median")
    return st.group_places(checked, ["species", "family"], *order).select("species", "family", "item", "place")


WORDS = q_terms.WORDS


@query(f"""WITH {WORDS}, c AS (SELECT term, count(DISTINCT p_partkey) AS parts FROM words GROUP BY 1) SELECT term, parts, row_number() OVER (ORDER BY parts DESC, term) AS place FROM c""")
def sorted_terms(spark, sf_dir):
    return st.places(q_terms.term_counts_long(spark, sf_dir).select("term", "parts"), F.desc("parts"), "term")


@query(q_terms.ENRICHED + """, o AS (SELECT comparison, term, q_bh, p_value FROM (SELECT comparison, term, round(q, 9) AS q_bh, round(p, 9) AS p_value FROM adjusted)) SELECT *, row_number() OVER (ORDER BY comparison, q_bh, p_value, term) AS place FROM o""")
def sorted_enrichment(spark, sf_dir):
    rows = q_terms.enrichment_hypergeom(spark, sf_dir).select("comparison", "term", "q_bh", "p_value")
    return st.places(rows, "comparison", "q_bh", "p_value", "term")


@query(f"""WITH {q_ranking.RANKED}, g AS (SELECT grp, family, round(avg(rank), 3) AS mean_rank FROM shifted GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY grp, mean_rank, family) AS place FROM g""")
def sorted_stability(spark, sf_dir):
    return st.places(q_ranking.rank_stability(spark, sf_dir).select("grp", "family", "mean_rank"), "grp", "mean_rank", "family")


@query(f"""WITH {q_ranking.RANKED}, b AS (SELECT grp, family, max(score) FILTER (scenario = 'eggnog_annotation_only') AS mapped, max(score) FILTER (scenario = 'direct_pfam_annotation_only') AS direct FROM shifted GROUP BY 1, 2), d AS (SELECT grp, family, round(mapped - direct, 6) AS difference FROM b)
SELECT *, row_number() OVER (ORDER BY grp, abs(difference) DESC, family) AS place FROM d""")
def annotation_bias(spark, sf_dir):
    """How far the score depends on where annotation comes from: the same family in two scenarios."""
    score = lambda n: F.max(F.when(F.col("scenario") == n, F.col("score")))
    rows = q_ranking.scenario_scores(spark, sf_dir).groupBy("grp", "family").agg(F.round(score("eggnog_annotation_only") - score("direct_pfam_annotation_only"), 6).alias("difference"))
    return st.places(rows, "grp", F.desc(F.abs("difference")), "family")


@query("""WITH s AS (SELECT p_partkey AS family, p_brand AS grp, p_size % 7 AS score, p_size % 5 AS evidence, p_size % 3 - 1 AS change FROM part)
SELECT family, row_number() OVER (ORDER BY score DESC, evidence DESC, abs(change) DESC, family) AS place FROM s""")
def selection_order(spark, sf_dir):
    s = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family"), (s % 7).alias("score"), (s % 5).alias("evidence"), (s % 3 - 1).alias("change"))
    return st.places(rows, F.desc("score"), F.desc("evidence"), F.desc(F.abs("change")), "family").select("family", "place")


@query("""WITH r AS (SELECT p_partkey AS family, p_brand AS grp, 100 * (p_size % 3) + 10 * (p_size % 4) + p_size - (p_size % 5) - greatest(0, p_size % 6 - 1) AS priority FROM part) SELECT *, row_number() OVER (ORDER BY priority DESC, grp, family) AS place FROM r""")
def reconciliation_order(spark, sf_dir):
    s = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family"), F.col("p_brand").alias("grp"), tr.priority(s % 3, s % 4, s, s % 5, s % 6).alias("priority"))
    return st.places(rows, F.desc("priority"), "grp", "family")


@query("""WITH c AS (SELECT l_partkey AS family, r_name AS species, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_linenumber = 1 GROUP BY 1, 2),
f AS (SELECT p_type AS grp, family, count(*) AS present, sum(n) AS total, bool_and(n = 1) AS single FROM c JOIN part ON p_partkey = family GROUP BY 1, 2)
SELECT grp, count(*) AS families, CAST(sum(total) AS BIGINT) AS copies, count(*) FILTER (present = 5 AND single) AS universal_single_copy, count(*) FILTER (present = 5 AND NOT single) AS universal_multicopy, count(*) FILTER (present = 4) AS near_core,
count(*) FILTER (present IN (2, 3)) AS shell, count(*) FILTER (present = 1) AS species_specific FROM f GROUP BY 1""")
def group_categories(spark, sf_dir):
    """A row per group with a column per category."""
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family"), F.col("p_type").alias("grp"))
    return oc.group_summary(oc.row_stats(copies(spark, sf_dir), REGIONS).join(groups, "family"), "grp")


@query("""SELECT metric, fraction, NULL::DOUBLE AS p_value FROM (SELECT lang || ' pass fraction' AS metric, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 6) AS fraction FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def proportions(spark, sf_dir):
    """Shares that are described, not tested: their p is null and stays null when p-values are adjusted."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    described = st.described_share(rows, F.concat("lang", F.lit(" pass fraction")), F.col("k"), F.col("n"))
    return st.benjamini_hochberg(described, "p_value", "q").where("q IS NULL").select("metric", F.round("fraction", 6).alias("fraction"), "p_value")


@query("""WITH seen AS (SELECT 'families' AS "check", (SELECT count(*) - count(DISTINCT p_partkey) FROM part) AS n, 0 AS want UNION ALL SELECT 'species', (SELECT count(*) FROM nation), 25
UNION ALL SELECT 'known customers', (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), 0
UNION ALL SELECT 'regions', (SELECT count(*) FROM region), 6 UNION ALL SELECT 'line numbers', (SELECT count(*) FROM lineitem WHERE l_linenumber < 1), 0)
SELECT "check", CASE WHEN n = want THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS VARCHAR) AS observed FROM seen""")
def consistency_checks(spark, sf_dir):
    """Observed beside expected numbers, in one job; the fourth is wrong on purpose."""
    p, o, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    number = lambda df: df.agg(F.count("*").alias("n"))
    return sinks.measured({
        "families": (p.groupBy("p_partkey").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))), 0), "species": (number(n), 25),
        "known customers": (number(jn.missing_keys(o.select(F.col("o_custkey").alias("c_custkey")), c, ["c_custkey"])), 0),
        "regions": (number(table(spark, sf_dir, "region")), 6), "line numbers": (number(table(spark, sf_dir, "lineitem").where("l_linenumber < 1")), 0),
    }).select("check", "status", "observed")


@query(f"WITH {q_ranking.RANKED} SELECT count(*) AS families, count(*) FILTER (score <> base OR rank <> base_rank OR tier <> base_tier) AS differ FROM shifted WHERE scenario = 'baseline'")
def baseline_reproduced(spark, sf_dir):
    """The baseline among the scenarios is the ranking it starts from."""
    r = q_ranking.ranked_families(spark, sf_dir).where("scenario = 'baseline'")
    return r.agg(F.count("*").alias("families"), F.count_if((F.col("score") != F.col("base")) | (F.col("rank") != F.col("base_rank")) | (F.col("tier") != F.col("base_tier"))).alias("differ"))


@query("SELECT p_brand AS grp, least(count(*), 30) AS selected FROM part GROUP BY 1")
def selected_per_group(spark, sf_dir):
    """Thirty families of each group that has so many."""
    top = rk.top_per(table(spark, sf_dir, "part"), ["p_brand"], 30, F.desc("p_size"), F.col("p_partkey"))
    return top.groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("selected"))
