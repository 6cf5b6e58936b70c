"""Queries of readers and writers: driver tables go out as files of each form to the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.core.shared import place
from quarrystone.functions import text as tx
from quarrystone.operators import joins as jn
from quarrystone.operators import sinks
from quarrystone.plans.base import REGIONS, copies, table
from quarrystone.plans.register import query
from quarrystone.sources import sequences as sq
from quarrystone.sources import tables as tb


def _place(spark, name):
    return place(spark, f"files-{name}")


def _lines(spark, name, *parts):
    """The path of a folder of text files, one for each (columns of one text)."""
    path = _place(spark, name)
    for rows in parts:
        rows.write.mode("append").text(path)
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || chr(10) || 'second \"line\"' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def tsv_round_trip(spark, sf_dir):
    """Cells with line breaks and quotes among them."""
    path = _place(spark, "tsv")
    name = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit('\nsecond "line"'))).otherwise(F.col("n_name"))
    n = table(spark, sf_dir, "nation").withColumns({"n_regionkey": F.nullif("n_regionkey", F.lit(0)), "n_name": name})
    sinks.write_tsv(n, path, ["n_name", "n_nationkey", "n_regionkey"])
    return tb.tsv(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "part key", '"' || p_name AS name, CASE WHEN p_size % 5 = 0 THEN 'NA' ELSE CAST(p_size AS VARCHAR) END AS size FROM part""")
def plain_tsv_round_trip(spark, sf_dir):
    """Quotes are letters and missing is NA, as statistics programs write it."""
    path = _place(spark, "plain")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part key"), F.concat(F.lit('"'), "p_name").alias("name"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"))
    sinks.write_tsv(p, path, p.columns, missing="NA", quoted=False)
    return tb.tsv(spark, path, quoted=False)


@query("SELECT o_orderpriority AS name, count(*) AS jobs, CAST(sum(o_orderkey % 100000) AS BIGINT) AS seconds FROM orders GROUP BY 1")
def ledger_scan(spark, sf_dir):
    """A ledger of pipe-separated cells with elapsed times."""
    s = F.col("o_orderkey") % 100000
    clock = F.format_string("%02d:%02d:%02d", (s % 86400 / 3600).cast("int"), (s % 3600 / 60).cast("int"), (s % 60).cast("int"))
    elapsed = F.when(s >= 86400, F.concat((s / 86400).cast("int").cast("string"), F.lit("-"), clock)).otherwise(clock)
    path = _place(spark, "ledger")
    table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("Name"), elapsed.alias("Elapsed")).write.option("sep", "|").option("header", True).csv(path)
    rows = tb.psv(spark, path)
    return rows.groupBy(F.col("Name").alias("name")).agg(F.count("*").alias("jobs"), F.sum(tb.elapsed_seconds(F.col("Elapsed"))).alias("seconds"))


COUNTS = """c AS (SELECT l_partkey AS family, r_name AS species, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_linenumber = 1 GROUP BY 1, 2),
f AS (SELECT DISTINCT family FROM c)"""


def _wide(spark, sf_dir):
    w = copies(spark, sf_dir).groupBy("family").pivot("species", list(REGIONS)).agg(F.sum("n")).na.fill(0)
    total = sum((F.col(r) for r in REGIONS), F.lit(0)) + (F.col("family") % 10 == 0).cast("int")  # every tenth stated total is wrong
    return w.select(F.col("family").alias("Orthogroup"), *REGIONS, total.alias("Total"))


@query(f"WITH {COUNTS} SELECT CAST(f.family AS VARCHAR) AS family, r_name AS species, CAST(coalesce(n, 0) AS INTEGER) AS n FROM f CROSS JOIN region LEFT JOIN c ON c.family = f.family AND c.species = r_name")
def counts_matrix_scan(spark, sf_dir):
    path = _place(spark, "counts")
    w = _wide(spark, sf_dir)
    sinks.write_tsv(w, path, w.columns)
    return tb.counts_matrix(spark, path)[0]


@query(f"WITH {COUNTS} SELECT CAST(family AS VARCHAR) AS family, CAST(sum(n) AS BIGINT) + 1 AS total FROM c WHERE family % 10 = 0 GROUP BY 1, family")
def wrong_totals(spark, sf_dir):
    path = _place(spark, "counts")
    w = _wide(spark, sf_dir)
    sinks.write_tsv(w, path, w.columns)
    return tb.counts_matrix(spark, path)[1].select("family", "total")


@query("SELECT CAST(p_partkey AS VARCHAR) AS family, node, CAST(CASE node WHEN 'A<1>' THEN p_size ELSE p_size * 2 END AS VARCHAR) AS value FROM part CROSS JOIN (VALUES ('A<1>'), ('<2>')) t(node)")
def node_matrix_scan(spark, sf_dir):
    path = _place(spark, "nodes")
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("FamilyID"), F.col("p_size").alias("A<1>"), (F.col("p_size") * 2).alias("<2>"))
    sinks.write_tsv(w, path, w.columns)
    return tb.node_matrix(spark, path)


@query("SELECT n_name AS key, n_regionkey || ': x' AS value FROM nation UNION ALL SELECT 'again', 'first'")
def key_values_scan(spark, sf_dir):
    """Of a key that comes twice the first line counts, though it stands in the smaller of two files."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.col("n_name"), F.lit("\t "), F.col("n_regionkey").cast("string"), F.lit(": x")).alias("line"))
    first = spark.createDataFrame([("again\tfirst",), ("no value",)], "line string").coalesce(1)
    rest = spark.createDataFrame([("again\tsecond",), ("again\tthird",)], "line string").unionByName(n).coalesce(1)
    return tb.key_values(spark, _lines(spark, "keys", first.unionByName(rest)))


SEQUENCE = "repeat(translate(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), '0123456789', 'ACDEFGHIKL'), 1 + p_size)"


def _sequences(spark, sf_dir):
    letters = F.translate(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), "0123456789", "ACDEFGHIKL")
    rows = table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(" "), "p_name").alias("id"), F.repeat(letters, 1 + F.col("p_size")).alias("seq"))
    path = _place(spark, "fasta")
    sinks.write_fasta(rows, path)
    return path


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS description, {SEQUENCE} AS seq FROM part")
def fasta_scan(spark, sf_dir):
    return sq.fasta(spark, _sequences(spark, sf_dir), "upper").drop("path")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, length({SEQUENCE}) AS length FROM part WHERE p_brand = 'Brand#3'")
def fasta_wanted(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").cast("string").alias("id"))
    return sq.fasta_of(spark, _sequences(spark, sf_dir), wanted).select("id", F.length("seq").cast("bigint").alias("length"))


@query("SELECT count(*) AS records, count(DISTINCT p_partkey) AS ids FROM part")
def fasta_count(spark, sf_dir):
    return sq.fasta_ids(spark, _sequences(spark, sf_dir)).agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))


@query("SELECT p_name AS id, count(DISTINCT p_size) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def conflicting_sequences(spark, sf_dir):
    """Ids that stand for several sequences."""
    return sq.conflicts(table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.repeat(F.lit("A"), F.col("p_size")).alias("seq")))


@query("""SELECT 'q' || p_partkey AS query, 's.' || p_size AS seed_ortholog, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS "Preferred_name" FROM part""")
def mapper_scan(spark, sf_dir):
    """Comments, a header with #, and rows that stop early."""
    p = table(spark, sf_dir, "part")
    short = F.concat_ws("\t", F.concat(F.lit("q"), "p_partkey"), F.concat(F.lit("s."), "p_size"))
    line = F.when(F.col("p_partkey") % 3 == 0, short).otherwise(F.concat_ws("\t", short, *[F.lit("-")] * 6, "p_name"))
    head = spark.createDataFrame([("## comment",), ("#query\tseed_ortholog",)], "line string")
    rows, _ = tb.mapper_annotations(spark, _lines(spark, "mapper", head, p.select(line)))
    return rows.select("query", "seed_ortholog", "Preferred_name")


def _domains(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 10")
    field = {0: F.replace("p_type", F.lit(" "), F.lit("_")), 1: F.concat(F.lit("PF"), "p_size", F.lit(".7")), 3: F.concat(F.lit("q"), "p_partkey"), 17: F.col("p_size").cast("string"), 18: (F.col("p_size") + 40).cast("string")}
    cells = [field.get(i, F.lit("1")) for i in range(22)]
    return tb.domain_hits(spark, _lines(spark, "domains", spark.createDataFrame([("# comment",), ("too short",)], "l string"), p.select(F.concat_ws("  ", *cells, F.lit("a description")))))


@query("SELECT 'q' || p_partkey AS query_id, 'PF' || p_size AS pfam_accession, p_size + 40 AS alignment_to, p_brand AS family, 'a description' AS description FROM part WHERE p_size > 10")
def domain_hits_of_families(spark, sf_dir):
    """Domain hits with what is known of their sequences."""
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), "p_partkey").alias("query_id"), F.col("p_brand").alias("family"))
    return _domains(spark, sf_dir).join(known, "query_id").select("query_id", "pfam_accession", F.col("alignment_to").cast("bigint").alias("alignment_to"), "family", "description")


@query("""SELECT 'q' || p_partkey AS query_id, string_agg('PF' || p_size || ':' || p_size || '-' || (p_size + 40), ';') AS architecture FROM part WHERE p_size > 10 GROUP BY 1""")
def sorted_hits(spark, sf_dir):
    """Each sequence's hits by start, end and accession."""
    hit = F.struct("alignment_from", "alignment_to", "pfam_accession")
    shown = F.transform(F.array_sort(F.collect_list(hit)), lambda h: F.concat(h["pfam_accession"], F.lit(":"), h["alignment_from"].cast("string"), F.lit("-"), h["alignment_to"].cast("string")))
    return _domains(spark, sf_dir).groupBy("query_id").agg(F.array_join(shown, ";").alias("architecture"))


def _ontology(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    alt = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\nalt_id: GO:9"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))).otherwise("")
    gone = F.when(F.col("n_nationkey") % 7 == 3, F.lit("\nis_obsolete: true")).otherwise("")
    stanza = F.concat(F.lit("[Term]\nid: GO:0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit("\nname: "), F.col("n_name"), F.lit("\nnamespace: region"), F.col("n_regionkey").cast("string"), alt, gone, F.lit("\n"))
    return tb.ontology(spark, _lines(spark, "obo", n.select(stanza)))


@query("SELECT 'GO:0' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS id, n_name AS name, 'region' || n_regionkey AS namespace FROM nation WHERE n_nationkey % 7 <> 3")
def ontology_scan(spark, sf_dir):
    return _ontology(spark, sf_dir)[0]


@query("""WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS k, c_nationkey AS n, c_custkey % 3 = 0 AS alt FROM customer),
t AS (SELECT c_custkey, CASE WHEN alt AND n % 2 = 0 AND n % 7 <> 3 THEN 'GO:0' || lpad(CAST(n AS VARCHAR), 3, '0') WHEN alt THEN 'GO:9' || lpad(CAST(n AS VARCHAR), 3, '0') ELSE 'GO:0' || lpad(CAST(n AS VARCHAR), 3, '0') END AS term,
  n % 7 <> 3 AND (NOT alt OR n % 2 = 0) AS known, n FROM u)
SELECT c_custkey, term, CASE WHEN known THEN n_name ELSE '' END AS name, CASE WHEN known THEN 'region' || n_regionkey ELSE 'unknown' END AS namespace FROM t JOIN nation ON n = n_nationkey""")
def primary_terms(spark, sf_dir):
    """Alternative ids become primary ones; terms that the ontology lacks have no name and an unknown namespace."""
    known, alternatives = _ontology(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    term = F.concat(F.when(F.col("c_custkey") % 3 == 0, "GO:9").otherwise("GO:0"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))
    primary = jn.with_fallback(c.select("c_custkey", term.alias("term")), alternatives.select(F.col("alt_id").alias("term"), F.col("id").alias("new")), "term", "new")
    named = primary.join(known.withColumnRenamed("id", "term"), "term", "left")
    return named.select("c_custkey", "term", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("namespace", F.lit("unknown")).alias("namespace"))


@query("SELECT 'c' || (p_partkey % 10) AS seqid, CAST(p_partkey AS BIGINT) AS start, CAST(p_partkey + p_size AS BIGINT) AS \"end\", 'cds' || p_partkey AS id, 'a=b' AS note FROM part WHERE p_size % 2 = 0")
def coding_features_scan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "CDS").otherwise("exon")
    line = F.concat_ws("\t", F.concat(F.lit("c"), (F.col("p_partkey") % 10).cast("string")), F.lit("src"), kind, "p_partkey", F.col("p_partkey") + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID=cds"), "p_partkey", F.lit(";Note=a=b;flag")))
    rows = tb.coding_features(spark, _lines(spark, "gff", spark.createDataFrame([("##gff-version 3",)], "l string"), p.select(line)))
    return rows.select("seqid", "start", "end", F.col("attrs")["ID"].alias("id"), F.col("attrs")["Note"].alias("note"))


@query("SELECT count(*) AS files, count(*) FILTER (n_nationkey % 4 <> 0) AS valid, CAST(sum(n_regionkey) FILTER (n_nationkey % 4 <> 0) AS BIGINT) AS total FROM nation")
def json_documents_scan(spark, sf_dir):
    """A document per file; a malformed one is null."""
    n = table(spark, sf_dir, "nation")
    body = F.when(F.col("n_nationkey") % 4 != 0, F.to_json(F.struct("n_name", "n_regionkey"))).otherwise(F.concat(F.lit("{broken "), "n_name"))
    docs = _documents(spark, n.select(body.alias("body")))
    return docs.agg(F.count("*").alias("files"), F.count("doc").alias("valid"), F.sum(F.try_variant_get("doc", "$.n_regionkey", "bigint")).alias("total"))


def _documents(spark, rows):
    """Each row as a file of its own, read as JSON documents."""
    path = _place(spark, "json")
    rows.withColumn("file", F.monotonically_increasing_id()).write.partitionBy("file").text(path)
    return tb.documents_json(spark, path)


@query("SELECT 'C' || n_nationkey AS species, round(90 + n_regionkey, 1)::DOUBLE AS complete, 1.5::DOUBLE AS duplicated, CAST(1000 + n_nationkey AS INTEGER) AS n FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 'C' || n_nationkey, NULL, NULL, -1 FROM nation WHERE n_nationkey % 5 = 4")
def completeness_scan(spark, sf_dir):
    """Short summaries, of which some state nothing."""
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.lit("C:"), (90 + F.col("n_regionkey")).cast("string"), F.lit(".0%[S:88.5%, D:1.5%],F:0.5%,M:0.5%,n:"), (1000 + F.col("n_nationkey")).cast("string"))
    body = F.concat(F.lit("# summary\n\t"), F.when(F.col("n_nationkey") % 5 != 4, line).otherwise("none"))
    path = _place(spark, "completeness")
    n.select(body.alias("body"), F.concat(F.lit("C"), "n_nationkey").alias("species")).write.partitionBy("species").text(path)
    rows = tb.completeness_reports(spark, path)
    return rows.select(F.regexp_extract("path", "species=([^/]+)", 1).alias("species"), "complete", "duplicated", F.coalesce("n", F.lit(-1)).alias("n"))


@query("SELECT 'F' || n_nationkey AS family, 'GTR+G' || n_regionkey AS best_model, '-' || n_nationkey || '.5' AS log_likelihood, CASE WHEN n_nationkey % 2 = 0 THEN '12' END AS alignment_sequences FROM nation")
def tree_reports_scan(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    body = F.concat(F.lit("Best-fit model according to BIC: GTR+G"), "n_regionkey", F.lit("\nLog-likelihood of the tree: -"), "n_nationkey", F.lit(".5 (s.e. 1)\n"), F.when(F.col("n_nationkey") % 2 == 0, "Input data: 12 sequences with 300 sites").otherwise(""))
    path = _place(spark, "reports")
    n.select(body.alias("body"), F.concat(F.lit("F"), "n_nationkey").alias("family")).write.partitionBy("family").text(path)
    return tb.tree_reports(spark, path).select(F.regexp_extract("path", "family=([^/]+)", 1).alias("family"), "best_model", "log_likelihood", "alignment_sequences")


@query("SELECT n_regionkey AS region, count(*) AS files, true AS sized, true AS recent FROM nation GROUP BY 1")
def file_listing(spark, sf_dir):
    """Names, sizes and times of the files in a folder; contents are not read."""
    path = _place(spark, "listing")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy("r", "k").text(path)
    rows = tb.files(spark, path).where(F.col("name").startswith("part-"))
    region = F.regexp_extract("path", "/r=([0-9]+)/", 1).cast("bigint")
    return rows.groupBy(region.alias("region")).agg(F.count("*").alias("files"), F.bool_and(F.col("length") > 0).alias("sized"), F.bool_and(F.col("modified") > F.lit("2000-01-01").cast("timestamp")).alias("recent"))


@query("SELECT 'r=' || n_regionkey AS step, count(*) AS files, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def step_files(spark, sf_dir):
    """Files and bytes of each step's folder."""
    path = _place(spark, "steps")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy("r", "k").text(path)
    return sinks.step_sizes(spark, path)


@query("SELECT 'T' || p_partkey AS \"Name\", CAST(p_size AS DOUBLE) AS \"Length\", round(p_retailprice, 2) AS \"TPM\" FROM part")
def quantification_scan(spark, sf_dir):
    path = _place(spark, "quant")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("T"), "p_partkey").alias("Name"), F.col("p_size").alias("Length"), F.col("p_size").alias("EffectiveLength"), F.round("p_retailprice", 2).alias("TPM"), F.lit(1).alias("NumReads"))
    sinks.write_tsv(p, path, p.columns)
    return tb.quantification(spark, path).select("Name", "Length", "TPM")


@query("SELECT 'k=' || n_nationkey AS folder, n_name AS value FROM nation")
def markers_scan(spark, sf_dir):
    """Files of one value, by their folder."""
    path = _place(spark, "markers")
    table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("  ")).alias("value"), F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy("k").text(path)
    return tb.markers(spark, path, "part-*").select(F.element_at(F.split("folder", "/"), -1).alias("folder"), "value")


@query("SELECT n_nationkey AS array_index, n_name AS name FROM nation WHERE n_nationkey = 7")
def manifest_task(spark, sf_dir):
    """The row of a manifest that an array task gets."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("array_index"), F.col("n_name").alias("name"))
    return spark.createDataFrame([tb.manifest_row(rows, 7)], "array_index bigint, name string")


@query("SELECT count(*) AS files, sum(CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 0 END)::BIGINT AS damaged FROM nation")
def verified_downloads(spark, sf_dir):
    """Files held against the digests that a list states."""
    n = table(spark, sf_dir, "nation")
    path = _place(spark, "downloads")
    n.select("n_name", F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy("k").text(path)
    stated = n.select(F.col("n_nationkey").alias("k"), F.md5(F.concat("n_name", F.when(F.col("n_nationkey") % 6 == 0, "x").otherwise("\n")).cast("binary")).alias("expected"))
    found = sinks.digests(spark, path, "md5").select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("bigint").alias("k"), F.col("md5").alias("found"))
    checked = sinks.against(stated, found, "k")
    return checked.agg(F.count("*").alias("files"), F.count_if(F.col("status") != "PASS").alias("damaged"))


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'api_key' ELSE 'token' END AS rule, count(*) AS files FROM nation WHERE n_nationkey % 3 < 2 GROUP BY 1")
def blocked_files(spark, sf_dir):
    """Texts that must not go into an archive."""
    n = table(spark, sf_dir, "nation")
    body = F.when(F.col("n_nationkey") % 3 == 0, "api_key=1").when(F.col("n_nationkey") % 3 == 1, "x token: y").otherwise("calm")
    path = _place(spark, "blocked")
    n.select(body.alias("body"), F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy("k").text(path)
    return sinks.blocked_content(spark, path, {"api_key": r"api_key\s*=", "token": r"token\s*:"}).groupBy("rule").agg(F.count("*").alias("files"))


@query("SELECT p_brand || '.tsv' AS output, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1")
def child_tables(spark, sf_dir):
    """Filtered tables of one parent, here one for each brand, all written in one pass."""
    rows = table(spark, sf_dir, "part").where("p_size > 40")
    path = _place(spark, "children")
    sinks.write_children(rows, path, F.concat("p_brand", F.lit(".tsv")))
    lines = spark.read.text(path).where(~F.col("value").startswith("p_partkey\t"))
    return lines.groupBy(F.col("output")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size > 40 THEN 'large' ELSE 'primary' END AS route, count(*) AS n FROM part GROUP BY 1")
def routed_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("route", F.when(F.col("p_size") > 40, "large").otherwise("primary"))
    return spark.createDataFrame(list(sinks.write_routed(p, _place(spark, "routed"), "route").items()), "route string, n bigint")


@query("SELECT l_returnflag AS route, count(*) AS stored, (SELECT count(*) FROM lineitem) AS written, (SELECT CAST(sum(l_linenumber) AS BIGINT) FROM lineitem) AS line_numbers, (SELECT min(l_orderkey) FROM lineitem) AS first FROM lineitem GROUP BY 1")
def observed_rows(spark, sf_dir):
    """What the files of each route hold, beside metrics taken while they were written."""
    path, rows = _place(spark, "observed"), table(spark, sf_dir, "lineitem")
    seen = sinks.observed_write(rows, path, {"written": F.count("*"), "line_numbers": F.sum("l_linenumber"), "first": F.min("l_orderkey")}, "l_returnflag")
    stored = spark.read.parquet(path).groupBy(F.col("l_returnflag").alias("route")).agg(F.count("*").alias("stored"))
    return stored.select("route", "stored", *[F.lit(v).alias(name) for name, v in seen.items()])


@query("SELECT n_regionkey, n_name FROM nation")
def exact_selection(spark, sf_dir):
    """Five nations of each of five regions, or the query fails."""
    return sinks.exactly(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), ["n_regionkey"], 5, 5)


@query("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation")
def committed_run(spark, sf_dir):
    """Two runs of which the pointer names the second; both carry their marker."""
    folder, n = _place(spark, "runs"), table(spark, sf_dir, "nation")
    sinks.commit(n.limit(0), folder, "1")
    sinks.commit(n, folder, "2")
    return sinks.latest(spark, folder).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))


@query("SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(65533) ELSE '' END AS name FROM part")
def readable_text(spark, sf_dir):
    """Bytes that are no UTF-8 become the replacement character."""
    raw = F.concat(F.encode("p_name", "utf-8"), F.when(F.col("p_partkey") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return table(spark, sf_dir, "part").select("p_partkey", tx.safe_text(raw).alias("name"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS taxon, n_regionkey AS region FROM nation")
def staged_table(spark, sf_dir):
    """A lookup table in SQLite on the driver, staged as Parquet."""
    import sqlite3

    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()]  # 25 rows
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE species (taxid INT, region INT)")
    db.executemany("INSERT INTO species VALUES (?, ?)", rows)
    return tb.sqlite_table(spark, db, "SELECT taxid, region FROM species", "taxon bigint, region bigint", rows=10)


@query("SELECT 'a' || (p_partkey // 100) AS archive, 'P' || p_partkey AS id, repeat('ACG', p_size) AS seq FROM part")
def archived_sequences(spark, sf_dir):
    """Records of the one sequence member of each ZIP archive, among others; an archive has a hundred records."""
    import io
    import zipfile

    def packed(records):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("data/readme.txt", "nothing")
            z.writestr("data/x/cds_from_genomic.fna", "".join(sorted(records)))
        return out.getvalue()

    head = F.concat(F.lit(">lcl|1 [gene=g] [protein_id=P"), "p_partkey", F.lit("] [x=y]\n"), F.repeat(F.lit("ACG"), "p_size"), F.lit("\n"))
    rows = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("a"), F.floor(F.col("p_partkey") / 100)).alias("path")).agg(F.collect_list(head).alias("records"))
    archives = rows.select("path", F.udf(packed, "binary", useArrow=True)("records").alias("content"))
    return sq.zipped_records(archives).withColumnRenamed("path", "archive")


@query("SELECT count(*) AS n, count(DISTINCT n_nationkey) AS keys, count(*) FILTER (n_regionkey > 1) AS first, 0 AS again FROM nation")
def synced_rows(spark, sf_dir):
    """What an archive lacks is appended once."""
    n, path = table(spark, sf_dir, "nation"), _place(spark, "archive")
    n.where("n_regionkey <= 1").write.parquet(path)
    first, again = sinks.sync(n, path, "n_nationkey"), sinks.sync(n, path, "n_nationkey")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("n_nationkey").alias("keys"), F.lit(first).cast("bigint").alias("first"), F.lit(again).alias("again"))


@query("SELECT * FROM (VALUES ('interpreter', 'ok'), ('nothing', 'missing'), ('failing', 'exit_3')) t(tool, status)")
def tool_versions(spark, sf_dir):
    """Programs of the driver's machine and whether they answer."""
    import sys

    from quarrystone.operators.audit import versions

    rows = versions([("interpreter", [sys.executable, "--version"]), ("nothing", ["no-such-program-here"]), ("failing", [sys.executable, "-c", "raise SystemExit(3)"])])
    return spark.createDataFrame([r[:2] for r in rows], "tool string, status string")


@query("SELECT count(*) AS bars, true AS titled FROM region")
def region_chart(spark, sf_dir):
    """A bar for each row of a summary, as SVG."""
    from quarrystone.operators.audit import bar_chart

    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy("n_regionkey").collect()  # a bar each
    svg = bar_chart("Nations & regions", [(f"<{r.n_regionkey}>", r.n) for r in rows])
    return spark.createDataFrame([(svg.count("<rect"), "Nations &amp; regions" in svg)], "bars bigint, titled boolean")
