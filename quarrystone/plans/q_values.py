"""Queries of helpers for text, numbers, sequences and JSON over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import arrays as arr
from quarrystone.functions import numbers as nu
from quarrystone.functions import text as tx
from quarrystone.operators import annotation as an
from quarrystone.operators import evolution as evo
from quarrystone.operators import occupancy as oc
from quarrystone.operators import scoring as sc
from quarrystone.operators import sensitivity as se
from quarrystone.operators import sinks
from quarrystone.operators import validation as va
from quarrystone.plans.base import spread, table
from quarrystone.plans.register import query


def _pick(key, *values):
    """One of the values, by the key modulo their number."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int") + 1)


@query("""WITH v AS (SELECT o_orderkey, list_extract(['', '-', 'NA', 'None', ' kept ', NULL, 'null'], o_orderkey % 7 + 1) AS a, list_extract(['N/A', 'second', ''], o_orderkey % 3 + 1) AS b FROM orders),
p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 4 THEN 'kept' ELSE '' END AS first, CASE WHEN o_orderkey % 3 = 1 THEN 'second' ELSE '' END AS second FROM v)
SELECT o_orderkey, first AS present, CASE WHEN first <> '' THEN first ELSE second END AS chosen, first <> '' OR second <> '' AS any_of FROM p""")
def missing_tokens(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b = _pick(k, "", "-", "NA", "None", " kept ", None, "null"), _pick(k, "N/A", "second", "")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.present(a).alias("present"), tx.first_present(a, b).alias("chosen"), tx.any_present(a, b).alias("any_of"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'functional_annotation' WHEN 1 THEN 'seed_ortholog_only' ELSE 'unannotated' END AS status FROM documents""")
def annotation_states(spark, sf_dir):
    """A functional field, else a seed, else nothing."""
    k = F.col("doc_id")
    status = an.status([_pick(k, "kinase", "-", ""), _pick(k, "-", "NA", "none")], _pick(k, "9606.P1", "6500.X2", "-"))
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


@query("""SELECT p_partkey, p_brand AS species, p_name AS gene, CASE WHEN p_partkey % 4 = 3 THEN CAST(p_size AS VARCHAR) ELSE 'OG' || p_size END AS family, p_partkey % 4 IN (0, 1) AS good FROM part""")
def composite_ids(spark, sf_dir):
    """Ids of three parts, with one part too many, or whose family has another form."""
    k = F.col("p_partkey") % 4
    ident = F.concat_ws("|", "p_brand", "p_name", F.concat(F.when(k == 3, "").otherwise("OG"), "p_size"), F.when(k == 2, "more"))
    species, gene, family, good = tx.composite_id(ident)
    return table(spark, sf_dir, "part").select("p_partkey", species.alias("species"), gene.alias("gene"), family.alias("family"), good.alias("good"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'ensembl_gene:ENSG' || p_partkey WHEN 1 THEN 'transdecoder_gene:g' || p_partkey WHEN 2 THEN 'refseq_locus:LOC' || p_partkey WHEN 3 THEN 'egw_locus:EGW' || p_partkey || '_1'
WHEN 4 THEN 'elyma_locus:ElyMa_' || p_partkey WHEN 5 THEN 'pob_locus:PoB_' || p_partkey ELSE 'unique_id:X' || p_partkey END AS gene_key,
list_extract(['ensembl_gene', 'transdecoder_gene', 'refseq_locus', 'egw_locus', 'elyma_locus', 'pob_locus', 'unique_id'], p_partkey % 7 + 1) AS rule FROM part""")
def gene_keys(spark, sf_dir):
    """A header or id for each of the rules."""
    k, n = F.col("p_partkey") % 7, F.col("p_partkey").cast("string")
    ident = F.when(k == 1, F.concat(F.lit("T_g"), n, F.lit("_i2.p1"))).otherwise(F.concat(F.lit("X"), n))
    said = {0: ("gene:ENSG", ""), 2: ("LOC", ""), 3: ("EGW", "_1"), 4: ("ElyMa_", ""), 5: ("PoB_", "")}
    header = ident
    for rule, (before, after) in said.items():
        header = F.when(k == rule, F.concat(ident, F.lit(" "), F.lit(before), n, F.lit(after), F.lit(" more"))).otherwise(header)
    key, rule = tx.gene_key(header, ident)
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("gene_key"), rule.alias("rule"))


@query("""SELECT p_partkey, trim(regexp_replace('_' || p_name || ' & ' || p_brand || '.', '[^A-Za-z0-9_.-]+', '_', 'g'), '_.-') AS label, CASE WHEN p_partkey % 2 = 0 THEN 'sequence' ELSE 'n' END AS short,
'gene' || p_size AS base, replace(p_name, ' ', '_') AS first FROM part""")
def safe_labels(spark, sf_dir):
    text = F.concat(F.lit("_"), "p_name", F.lit(" & "), "p_brand", F.lit("."))
    odd = F.when(F.col("p_partkey") % 2 == 0, "_--.").otherwise("n")
    versioned = F.concat(F.lit("gene"), "p_size", F.lit("."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.label(text).alias("label"), tx.label(odd).alias("short"), tx.without_version(versioned).alias("base"), tx.label(F.col("p_name")).alias("first"))


@query("""SELECT n_name, 'Nation ' || n_nationkey AS label, CASE WHEN n_regionkey < 2 THEN 'West' WHEN n_regionkey < 4 THEN 'East' ELSE 'Supplementary' END AS grp FROM nation""")
def display_labels(spark, sf_dir):
    r = F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select("n_name", tx.display_label(F.lower("n_name")).alias("label"), F.when(r < 2, "West").when(r < 4, "East").otherwise("Supplementary").alias("grp"))


@query("""SELECT o_orderkey, format('{:.3f}', o_totalprice) AS fixed, format('{:.6f}', o_totalprice / 7) AS six, format('{:.8g}', o_totalprice * 1000) AS general, format('{:.12g}', o_totalprice / 3) AS twelve FROM orders""")
def formatted_numbers(spark, sf_dir):
    v = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", sinks.python_format(v, ".3f").alias("fixed"), sinks.python_format(v / 7, ".6f").alias("six"), sinks.python_format(v * 1000, ".8g").alias("general"), sinks.python_format(v / 3, ".12g").alias("twelve")
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey::DOUBLE WHEN 1 THEN o_orderkey + 0.5 WHEN 4 THEN -1.0 * o_orderkey END::DOUBLE AS number, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 4 THEN -o_orderkey ELSE 9 END AS whole,
CASE WHEN o_orderkey % 6 IN (0, 1) AND o_orderkey > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS clamped FROM orders""")
def coerced_numbers(spark, sf_dir):
    """Numbers as text: whole, with a fraction, not finite, negative, blank and no number at all."""
    n, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    t = F.when(kind == 0, n).when(kind == 1, F.concat(n, F.lit(".5"))).when(kind == 2, "inf").when(kind == 3, "").when(kind == 4, F.concat(F.lit("-"), n)).otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", nu.finite(t).alias("number"), nu.whole(t, 9).alias("whole"), nu.clamp(nu.finite(t, 0.0)).alias("clamped"))


@query("SELECT o_orderkey, strftime(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS utc FROM orders")
def utc_times(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.iso_utc(F.timestamp_seconds(F.col("o_orderkey") * 1000)).alias("utc"))


DNA = "translate(lpad(CAST(o_orderkey AS VARCHAR), 9, '7'), '0123456789', 'ACGTACGTAC')"


def _dna():
    return F.translate(F.lpad(F.col("o_orderkey").cast("string"), 9, "7"), "0123456789", "ACGTACGTAC")


@query(f"""WITH s AS (SELECT o_orderkey, {DNA} AS s FROM orders)
SELECT o_orderkey, translate(reverse(s), 'ACGT', 'TGCA') AS reversed, substr(s, 1, 4) || chr(10) || substr(s, 5, 4) || chr(10) || substr(s, 9) AS lines, substr(s, 1, 3) || '---' || substr(s, 4, 6) AS aligned, 0.25::DOUBLE AS gaps FROM s""")
def sequence_forms(spark, sf_dir):
    """Reverse complement, wrapped lines, and codons put back behind an aligned protein."""
    s = _dna()
    aligned = arr.back_translated(F.lit("M-KL"), s)
    return table(spark, sf_dir, "orders").select("o_orderkey", arr.reverse_complement(s).alias("reversed"), arr.wrapped(s, 4).alias("lines"), aligned.alias("aligned"), arr.gap_share(aligned).alias("gaps"))


_AA = lambda i: f"substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(1 + 16 * (strpos('TCAG', substr(s, {i}, 1)) - 1) + 4 * (strpos('TCAG', substr(s, {i} + 1, 1)) - 1) + strpos('TCAG', substr(s, {i} + 2, 1)) - 1 AS INTEGER), 1)"
PROTEIN = f"regexp_replace({_AA(1)} || {_AA(4)} || {_AA(7)}, '[*]+$', '')"


@query(f"""WITH s AS (SELECT o_orderkey, {DNA} AS s FROM orders) SELECT o_orderkey, {PROTEIN} AS protein, s AS cds FROM s""")
def translate_check(spark, sf_dir):
    """Lower case and U are cleaned first."""
    cds = arr.clean_cds(F.lower(F.translate(_dna(), "T", "U")))
    return table(spark, sf_dir, "orders").select("o_orderkey", arr.translated(cds).alias("protein"), cds.alias("cds"))


@query(f"""WITH s AS (SELECT o_orderkey, {DNA} AS s FROM orders), p AS (SELECT o_orderkey, {PROTEIN} AS p FROM s)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NOT contains(p, '*') WHEN 1 THEN false ELSE NOT contains(p, '*') END AS same FROM p WHERE length(p) > 1""")
def compatible_proteins(spark, sf_dir):
    """A protein beside itself, beside itself with a letter more, and with its last letter unknown."""
    p, k = arr.translated(_dna()), F.col("o_orderkey") % 3
    other = F.when(k == 0, F.col("p")).when(k == 1, F.concat("p", F.lit("A"))).otherwise(F.concat(F.substring("p", F.lit(1), F.length("p") - 1), F.lit("X")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).where(F.length("p") > 1)
    return rows.select("o_orderkey", arr.compatible(F.col("p"), other).alias("same"))


ALIGNED = "translate(lpad(CAST(o_orderkey AS VARCHAR), 9, '7'), '0123456789', 'ACGTACGT-N')"


@query(f"""WITH s AS (SELECT o_custkey AS family, o_orderkey AS id, {ALIGNED} AS s FROM orders), c AS (SELECT family, id, pos, substr(s, 3 * pos - 2, 3) AS codon FROM s CROSS JOIN (VALUES (1), (2), (3)) t(pos)),
n AS (SELECT family, count(*) AS n FROM s GROUP BY 1), g AS (SELECT family, pos FROM (SELECT family, pos, count(*) FILTER (NOT contains(codon, '-') AND NOT contains(codon, 'N') AND codon NOT IN ('TAA', 'TAG', 'TGA')) AS v FROM c GROUP BY 1, 2) JOIN n USING (family) WHERE v >= greatest(3, ceil(0.5 * n)))
SELECT s.id, coalesce(string_agg(codon, '' ORDER BY pos), '') AS kept FROM s LEFT JOIN (SELECT * FROM c JOIN g USING (family, pos)) k ON k.family = s.family AND k.id = s.id GROUP BY 1""")
def codon_column_filter(spark, sf_dir):
    seq = F.translate(F.lpad(F.col("o_orderkey").cast("string"), 9, "7"), "0123456789", "ACGTACGT-N")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("id"), seq.alias("seq"))
    return evo.kept_codons(rows).select("id", "kept")


@query("""SELECT p_partkey, p_size * 2 || '/' || (p_partkey % 101) AS label, CASE WHEN p_size * 2 >= 80 AND p_partkey % 101 >= 95 THEN 'strong' WHEN p_size * 2 >= 80 OR p_partkey % 101 >= 95 THEN 'partial_strong'
WHEN p_size * 2 >= 60 OR p_partkey % 101 >= 70 THEN 'moderate' ELSE 'low' END AS support, 'unknown' AS none FROM part""")
def support_classes(spark, sf_dir):
    label = F.concat_ws("/", F.col("p_size") * 2, F.col("p_partkey") % 101)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), va.support_class(label).alias("support"), va.support_class(F.col("p_name")).alias("none"))


LINEAGE = "list_extract(['virus', 'bacteria', 'archaea', 'metazoa', 'fungi', 'viridiplantae', 'alveolata', 'stramenopiles', 'other_eukaryote', 'unknown'], p_partkey % 10 + 1)"


@query(f"SELECT p_partkey, {LINEAGE} AS lineage FROM part")
def lineages(spark, sf_dir):
    """Tracks of ancestors, where several known ones stand together."""
    track = _pick(F.col("p_partkey"), "1, 10239", "131567,2,1224", "131567,2157", "131567,2759,33208", "4751,2759", "2759,33090", "2759 , 33630", "33634,2759", "2759,1", "22,20")
    return table(spark, sf_dir, "part").select("p_partkey", va.lineage(track).alias("lineage"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'intensified' WHEN p_size < 25 THEN 'relaxed' ELSE 'unchanged' END AS label, '' AS none FROM part""")
def relax_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sc.relax_label(F.col("p_size") / 25.0).alias("label"), sc.relax_label(F.lit(None).cast("double")).alias("none"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS items FROM part""")
def listed_items(spark, sf_dir):
    cell = _pick(F.col("p_partkey"), " ", "a, b", " a ,,b,c", None)
    return table(spark, sf_dir, "part").select("p_partkey", oc.comma_items(cell).alias("items"))


@query("""SELECT p_partkey, p_size + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS risks, p_size = 0 AND p_partkey % 2 = 1 AS clean FROM part""")
def risk_counters(spark, sf_dir):
    """Four counters, of which some are text or missing."""
    c = se.risk_count(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "3.0").otherwise("NA"), F.lit(""), F.lit(None).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("risks"), (c == 0).alias("clean"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS found, value / 100 AS p_value, value AS lrt FROM events""")
def test_results(spark, sf_dir):
    """Numbers of nested results: one by any key that holds a text, others by their names."""
    doc = F.to_json(F.struct(F.struct((F.col("value") / 100).alias("p-value"), F.col("value").alias("LRT")).alias("test results")))
    nested = F.concat(F.lit('{"a": [{"b": "x"}, {"Inner Key": '), "props", F.lit("}]}"))
    return spread(table(spark, sf_dir, "events").select("event_id", "props", "value")).select("event_id", evo.find_number(nested, "K").alias("found"), evo.test_result(doc, "p-value").alias("p_value"), evo.test_result(doc, "LRT").alias("lrt"))


@query("""SELECT event_id, branch, CASE branch WHEN 'n1' THEN value / 100 ELSE 1.0::DOUBLE END AS corrected_p, CASE branch WHEN 'n1' THEN value ELSE NULL END AS omega FROM events CROSS JOIN (VALUES ('n1'), ('n2')) t(branch)""")
def branch_attributes(spark, sf_dir):
    """The first partition of the branches' attributes."""
    first = F.struct((F.col("value") / 100).alias("Corrected P-value"), F.col("value").alias("Baseline MG94 omega ratio"), F.lit(9.0).alias("Full omega"))
    doc = F.to_json(F.struct(F.struct(F.struct(first.alias("n1"), F.struct(F.lit(1.0).alias("Corrected P-value")).alias("n2")).alias("0"), F.struct(first.alias("n9")).alias("1")).alias("branch attributes")))
    return evo.branch_table(spread(table(spark, sf_dir, "events").select("event_id", "value")).select("event_id", doc.alias("doc")), "doc")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS array_index FROM part")
def array_indices(spark, sf_dir):
    """Stable numbers of array tasks within each group."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("rank"))
    return evo.event_members(rows, "p_brand").select("p_partkey", "array_index")
