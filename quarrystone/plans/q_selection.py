"""Queries of selection, availability and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.core.shared import place
from quarrystone.operators import selection as se
from quarrystone.operators import sinks
from quarrystone.plans.base import table
from quarrystone.plans.register import query


@query("""WITH r AS (SELECT source, doc_id, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 'refseq_locus:LOC' || (doc_id % 7) ELSE 'unique_id:' || doc_id END AS gene_key FROM documents)
SELECT source AS species, gene_key, CASE WHEN starts_with(gene_key, 'refseq') THEN 'refseq_locus' ELSE 'unique_id' END AS rule, arg_max(CAST(doc_id AS VARCHAR), n::HUGEINT * 100000 + rk) AS kept, max(n) AS length, count(*) AS isoforms
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) AS rk FROM r) GROUP BY 1, 2""")
def isoform_select(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ident = F.col("doc_id").cast("string")
    header = F.when(F.col("doc_id") % 3 == 0, F.concat(ident, F.lit(" LOC"), (F.col("doc_id") % 7).cast("string"))).otherwise(ident)
    return se.longest_isoforms(d.select(F.col("source").alias("species"), ident.alias("id"), header.alias("header"), F.col("text").alias("seq")))


@query("""WITH r AS (SELECT source AS species, CASE WHEN doc_id % 3 = 0 THEN 'refseq_locus' ELSE 'unique_id' END AS rule, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE doc_id + 100 END) AS n FROM documents GROUP BY 1, 2)
SELECT species, string_agg(rule || ':' || n, ';' ORDER BY rule) AS rules FROM r GROUP BY 1""")
def rule_counters(spark, sf_dir):
    return se.rule_counts(isoform_select(spark, sf_dir))


@query("""WITH s AS (SELECT source AS species, round(100.0::DOUBLE * count(quality) / count(*), 1) AS complete_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT species, complete_pct, CASE WHEN complete_pct >= 40 THEN 'core' ELSE 'supplementary' END AS analysis_role, 'BUSCO complete ' || format('{:.1f}', complete_pct) || CASE WHEN complete_pct >= 40 THEN '% >= 40.0%' ELSE '% < 40.0%' END AS reason FROM s""")
def core_set(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = d.groupBy(F.col("source").alias("species")).agg(F.round(100.0 * F.count("quality") / F.count("*"), 1).alias("complete_pct"))
    return se.core_set(s, least=40.0)


@query("""WITH a AS (SELECT p_type AS family, count(*) AS original, count(*) FILTER (p_size > 5) AS kept, count(DISTINCT p_brand) FILTER (p_size > 5) AS species, count(DISTINCT p_name) FILTER (p_size > 5) AS uniq,
count(*) FILTER (p_size > 40) AS direct, count(*) FILTER (p_size BETWEEN 6 AND 10) AS review, max(p_size) AS change FROM part GROUP BY 1)
SELECT family, round(kept % 13 + least(abs(change), 100.0) * 0.1 + species * 2.0 + direct / greatest(kept, 1)::DOUBLE * 10 - review / greatest(kept, 1)::DOUBLE * 4 - (original - kept) / original::DOUBLE * 3, 6) AS score,
kept >= 4 AND species >= 3 AND uniq >= 3 AS eligible, array_to_string(list_filter([CASE WHEN kept < 4 THEN 'too_few_strict_sequences' END, CASE WHEN species < 3 THEN 'too_few_species' END, CASE WHEN uniq < 3 THEN 'too_few_unique_sequences' END], lambda x: x IS NOT NULL), ';') AS why FROM a""")
def selection_score(spark, sf_dir):
    big = F.col("p_size") > 5
    a = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family")).agg(
        F.count("*").alias("original"), F.count_if(big).alias("kept"), F.countDistinct(F.when(big, F.col("p_brand"))).alias("species"), F.countDistinct(F.when(big, F.col("p_name"))).alias("uniq"),
        F.count_if(F.col("p_size") > 40).alias("direct"), F.count_if(F.col("p_size").between(6, 10)).alias("review"), F.max("p_size").alias("change"),
    )
    c = F.col
    ok, why = se.eligible(c("kept"), c("species"), c("uniq"))
    return a.select("family", F.round(se.selection_score(c("kept") % 13, c("change"), c("species"), c("direct"), c("review"), c("kept"), c("original")), 6).alias("score"), ok.alias("eligible"), why.alias("why"))


@query("""SELECT CASE WHEN n_regionkey < 2 THEN 'west' ELSE 'east' END AS grp, n_name AS species, CASE WHEN n_nationkey % 2 = 0 THEN 'available_single_library' ELSE 'unavailable' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 'R' || n_nationkey ELSE '' END AS accession FROM nation
UNION ALL SELECT 'supplementary_not_integrated', 'OTHER', 'available_taxon_mismatch', 'R99'""")
def data_audit(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    species = n.select(F.when(F.col("n_regionkey") < 2, "west").otherwise("east").alias("grp"), F.col("n_name").alias("species"))
    libraries = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("species"), F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("accession"))
    return se.availability(species, libraries, spark.createDataFrame([("OTHER", "R99")], "species string, accession string"))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'failed' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'complete' ELSE 'missing' END AS status FROM customer""")
def run_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return se.run_status(table(spark, sf_dir, "customer").select("c_custkey"), o, o.where("o_orderstatus = 'F'"), "c_custkey")


@query()
def audit_manifest(spark, sf_dir):
    return sinks.manifest(spark, sf_dir, "sha256").drop("path")


@query("""WITH t AS (SELECT c_nationkey, string_agg(c_custkey || chr(9) || c_name, chr(10) ORDER BY c_custkey) || chr(10) AS body FROM customer GROUP BY 1)
SELECT 'nation=' || c_nationkey AS folder, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM t""")
def file_manifest(spark, sf_dir):
    """Bytes and digests of a text file for each nation, its customers in order; markers are not listed."""
    path = place(spark, "files-manifest")
    line = F.concat_ws("\t", "c_custkey", "c_name")
    rows = table(spark, sf_dir, "customer").select(line.alias("line"), F.col("c_nationkey").alias("nation"), "c_custkey").repartition("nation").sortWithinPartitions("nation", "c_custkey")
    rows.drop("c_custkey").write.partitionBy("nation").text(path)
    return sinks.manifest(spark, path, "sha256").select(F.regexp_extract("path", "(nation=[0-9]+)/", 1).alias("folder"), "bytes", "sha256")


@query("""WITH s AS (SELECT source AS species, 100.0::DOUBLE * count(quality) / count(*) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source AS species, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN s ON source = species WHERE round(pct, 1) >= 25 GROUP BY 1""")
def core_rows(spark, sf_dir):
    """The rows of core species, written to a folder of their own and read back; without at least one of these it fails."""
    path = place(spark, "files-core")
    docs = table(spark, sf_dir, "documents")
    s = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy(F.col("source").alias("species")).agg(F.round(100.0 * F.count("quality") / F.count("*"), 1).alias("complete_pct"))
    se.write_core(docs.withColumnRenamed("source", "species"), se.core_set(s, least=25.0), path, least_core=1)
    return spark.read.parquet(path).groupBy("species").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, count(*) FILTER (value >= 10) AS detected FROM events GROUP BY 1, 2""")
def windowed_detection(spark, sf_dir):
    from quarrystone.streaming.events import windowed_detection as windows

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(e, "event_type", "value", (10.0,)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("detected_0").alias("detected"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g), c AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def session_counts(spark, sf_dir):
    from quarrystone.streaming.events import sessions

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
