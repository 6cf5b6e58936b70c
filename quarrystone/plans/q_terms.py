"""Queries of terms: the words of a part's name, type and brand are its terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import arrays as arr
from quarrystone.functions import stats as st
from quarrystone.functions import text as tx
from quarrystone.operators import annotation as an
from quarrystone.plans.base import table
from quarrystone.plans.register import query


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn, sum(n) OVER (PARTITION BY p_brand) AS total, count(*) OVER (PARTITION BY p_brand) AS kinds FROM c)
SELECT p_brand, p_type AS consensus, n AS support, round(n / total::DOUBLE, 6) AS share, kinds FROM r WHERE rn = 1""")
def consensus_mode(spark, sf_dir):
    return an.consensus(table(spark, sf_dir, "part"), ["p_brand"], "p_type").select("p_brand", "consensus", "support", F.round("share", 6).alias("share"), "kinds")


def _words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.explode(tx.terms(F.col("p_name"), " ")).alias("term"))


WORDS = "words AS (SELECT DISTINCT p_partkey, p_brand, p_type, p_size, unnest(string_split(p_name, ' ')) AS term FROM part)"


@query(f"WITH {WORDS} SELECT p_brand, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM words GROUP BY 1")
def term_union(spark, sf_dir):
    return an.term_union(_words(spark, sf_dir), ["p_brand"], "term").withColumn("terms", F.array_join("terms", ","))


@query(f"""WITH {WORDS} SELECT term, count(DISTINCT p_partkey) AS parts, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM words GROUP BY 1""")
def term_counts_long(spark, sf_dir):
    return an.term_counts(_words(spark, sf_dir), "term", {"parts": "p_partkey", "brands": "p_brand", "types": "p_type"})


@query("""SELECT metric, n, total, round(n / total::DOUBLE, 6) AS share FROM (
SELECT unnest(['labelled', 'good', 'toxic', 'short', 'english']) AS metric,
unnest([count(quality), count(*) FILTER (quality = 1), count(*) FILTER (toxic = 1), count(*) FILTER (n_chars < 500), count(*) FILTER (lang = 'en')]) AS n, count(*) AS total
FROM documents LEFT JOIN labels USING (doc_id))""")
def coverage_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return an.coverage(
        d,
        {
            "labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1,
            "short": F.col("n_chars") < 500, "english": F.col("lang") == "en",
        },
    ).withColumn("share", F.round("share", 6))


@query("""SELECT source AS family, count(*) AS n, count(quality) AS annotated, round(count(quality) / count(*)::DOUBLE, 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def family_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return an.family_coverage(d.select(F.col("source").alias("family"), F.col("quality").isNotNull().alias("known")), "family", F.col("known")).withColumn("share", F.round("share", 6))


ENRICH = f"""{WORDS},
pop AS (SELECT count(DISTINCT p_partkey) AS population FROM words),
target AS (SELECT DISTINCT p_brand AS comparison, p_partkey FROM words),
drawn AS (SELECT comparison, count(*) AS drawn FROM target GROUP BY 1 HAVING count(*) >= 5),
marked AS (SELECT term, count(DISTINCT p_partkey) AS marked FROM words GROUP BY 1),
hits AS (SELECT p_brand AS comparison, term, count(DISTINCT p_partkey) AS hits FROM words GROUP BY 1, 2),
cells AS (SELECT comparison, term, population, marked, drawn, hits FROM hits JOIN drawn USING (comparison) JOIN marked USING (term), pop
          WHERE hits >= 3 AND marked >= 5 AND drawn >= 5 AND population > drawn)"""


def _cells(spark, sf_dir):
    w = _words(spark, sf_dir).select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("comparison"), "term")
    return an.contingency(w.select("item", "term"), w.select("comparison", "item"))


@query(f"WITH {ENRICH} SELECT * FROM cells")
def contingency_counts(spark, sf_dir):
    return _cells(spark, sf_dir)


ENRICHED = f"""WITH {ENRICH}, lf AS (SELECT list(lgamma(i + 1) ORDER BY i) AS lf FROM range(0, 200001) t(i)),
tails AS (
  SELECT comparison, term, population, marked, drawn, hits,
         least(1.0, list_sum(list_transform(range(hits, least(marked, drawn) + 1), lambda i:
           exp(lf[marked + 1] - lf[i + 1] - lf[marked - i + 1] + lf[population - marked + 1] - lf[drawn - i + 1] - lf[population - marked - drawn + i + 1]
               - lf[population + 1] + lf[drawn + 1] + lf[population - drawn + 1])))) AS p
  FROM cells, lf
), r AS (SELECT *, count(*) OVER (PARTITION BY comparison) AS m, row_number() OVER (PARTITION BY comparison ORDER BY p) AS rn FROM tails),
adjusted AS (SELECT *, least(1.0, min(p * m / rn) OVER (PARTITION BY comparison ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)"""


@query(ENRICHED + """
SELECT comparison, term, hits, round(p, 9) AS p_value, round(q, 9) AS q_bh,
       round((hits / drawn::DOUBLE) / (marked / population::DOUBLE), 6) AS fold,
       round((hits + 0.5) * (population - drawn - (marked - hits) + 0.5) / ((drawn - hits + 0.5) * (marked - hits + 0.5)), 6) AS odds_ratio
FROM adjusted""")
def enrichment_hypergeom(spark, sf_dir):
    got = an.enrichment(_cells(spark, sf_dir), ["comparison"])
    return got.select("comparison", "term", "hits", F.round("p_value", 9).alias("p_value"), F.round("q_bh", 9).alias("q_bh"), F.round("fold", 6).alias("fold"), F.round("odds_ratio", 6).alias("odds_ratio"))


@query(f"""WITH {ENRICH}, s AS (SELECT comparison, count(*) AS tested FROM cells GROUP BY 1)
SELECT comparison, coalesce(tested, 0) AS tested FROM (SELECT DISTINCT p_brand AS comparison FROM part) LEFT JOIN s USING (comparison)""")
def enrichment_summary(spark, sf_dir):
    dim = table(spark, sf_dir, "part").select(F.col("p_brand").alias("comparison")).distinct()
    got = _cells(spark, sf_dir).groupBy("comparison").agg(F.count("*").alias("tested"))
    return dim.join(got, "comparison", "left").select("comparison", F.coalesce("tested", F.lit(0)).alias("tested"))


@query(f"""WITH {WORDS}, n AS (SELECT p_brand, count(DISTINCT p_partkey) AS n FROM words GROUP BY 1), c AS (SELECT p_brand, term, count(DISTINCT p_partkey) AS k FROM words GROUP BY 1, 2)
SELECT p_brand, string_agg(term, ';' ORDER BY term) AS core FROM c JOIN n USING (p_brand) WHERE n >= 3 AND k >= greatest(2, ceil(0.2 * n)) GROUP BY 1""")
def core_terms(spark, sf_dir):
    w = _words(spark, sf_dir).select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("item"), "term")
    return an.core_terms(w, share=0.2).select(F.col("family").alias("p_brand"), F.array_join("core", ";").alias("core"))


@query("""SELECT a.p_partkey, b.p_partkey AS other, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS jaccard
FROM (SELECT p_partkey, p_brand, list_distinct(string_split(p_name, ' ')) AS t FROM part) a JOIN (SELECT p_partkey, p_brand, list_distinct(string_split(p_name, ' ')) AS t FROM part) b
ON a.p_partkey + 1 = b.p_partkey""")
def jaccard_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", tx.terms(F.col("p_name"), " ").alias("t"))
    o = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("other"), F.col("t").alias("u"))
    return p.join(o, p.p_partkey == o.k).select("p_partkey", "other", F.round(arr.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("""SELECT o_orderpriority, round(ps.rho, 6) AS rho FROM (SELECT o_orderpriority, corr(rx, ry) AS rho FROM (
SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS ry FROM orders) GROUP BY 1) ps""")
def spearman_by_group(spark, sf_dir):
    o, by = table(spark, sf_dir, "orders"), ["o_orderpriority"]
    ranked = st.average_ranks(st.average_ranks(o.select("o_orderpriority", "o_totalprice", "o_custkey"), by, "o_totalprice", "rx"), by, "o_custkey", "ry")
    return ranked.groupBy("o_orderpriority").agg(F.round(st.pearson(F.col("rx"), F.col("ry")), 6).alias("rho"))
