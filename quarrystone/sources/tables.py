"""Readers of delimited tables and reports, as text first and typed after."""

from __future__ import annotations

import sqlite3
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.core.shared import place
from quarrystone.functions.numbers import finite


def tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, quoted: bool = True) -> DataFrame:
    """A table with a header, every cell text; ``quoted`` off reads quotes as letters.

    A quoted cell may hold line breaks, so a quoted file is read by one task;
    files without quotes are split. With ``columns`` the header must have them
    all, and just these are kept.
    A file without a header is an error; bytes that are no UTF-8 become the
    replacement character.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"' if quoted else "").option("escape", '"').option("multiLine", quoted)
    df = reader.csv(path)
    if not df.columns:
        raise ValueError(f"{path} has no header")
    if columns is not None:
        lacking = [c for c in columns if c not in df.columns]
        if lacking:
            raise ValueError(f"{path} has no column {', '.join(lacking)}")
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    return df


def psv(spark: SparkSession, path: str) -> DataFrame:
    """A ledger whose cells are separated by pipes."""
    return spark.read.option("sep", "|").option("header", True).csv(path)


def counts_matrix(spark: SparkSession, path: str, first: str = "Orthogroup", last: str = "Total") -> tuple[DataFrame, DataFrame]:
    """(long counts (family, species, n), rows whose stated total is wrong) of a
    table whose first column is the family and whose last the total."""
    wide = tsv(spark, path).where(F.col(f"`{first}`").isNotNull())
    if wide.columns[0] != first or wide.columns[-1] != last:
        raise ValueError(f"{path} must begin with {first} and end with {last}")
    species = wide.columns[1:-1]
    typed = wide.select(F.col(first).alias("family"), *[F.col(f"`{s}`").cast("double").cast("int").alias(s) for s in species], F.col(last).cast("double").cast("bigint").alias("total"))
    wrong = typed.where(F.col("total") != sum((F.col(f"`{s}`") for s in species), F.lit(0)))
    return typed.unpivot("family", [F.col(f"`{s}`") for s in species], "species", "n"), wrong


def node_matrix(spark: SparkSession, path: str, key: str = "FamilyID") -> DataFrame:
    """Long (family, node, value) of a table with a column per node."""
    wide = tsv(spark, path)
    nodes = [c for c in wide.columns if c != key]
    return wide.unpivot(F.col(f"`{key}`"), [F.col(f"`{n}`") for n in nodes], "node", "value").withColumnRenamed(key, "family")


def key_values(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(key, value): the first line of each key wins, files in the order of their names."""
    # A task reads its ranges in order, so the number tells lines of one range apart; which ranges it reads first does not matter.
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("_n"))
    parts = F.split("value", separator, 2)
    rows = lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"), "_n")
    return rows.groupBy("key").agg(F.min_by("value", "_n").alias("value"))


# Columns of the annotation mapper's table, after its query.
MAPPER = (
    "query", "seed_ortholog", "evalue", "score", "eggNOG_OGs", "max_annot_lvl", "COG_category", "Description", "Preferred_name", "GOs", "EC", "KEGG_ko",
    "KEGG_Pathway", "KEGG_Module", "KEGG_Reaction", "KEGG_rclass", "BRITE", "KEGG_TC", "CAZy", "BiGG_Reaction", "PFAMs",
)


def mapper_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, repeated or empty queries): lines of comments are skipped, short rows filled up."""
    cells = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    rows = cells.select(*[F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(MAPPER)])
    wrong = rows.groupBy("query").agg(F.count("*").alias("n")).where("n > 1 or query = ''")
    return rows, wrong


# Columns of a domain table, in order of its fields.
DOMAIN_FIELDS: Mapping[str, tuple[int, str]] = {
    "pfam_name": (0, "string"), "query_id": (3, "string"), "full_evalue": (6, "double"), "full_score": (7, "double"), "domain_index": (9, "int"), "domain_total": (10, "int"),
    "conditional_evalue": (11, "double"), "independent_evalue": (12, "double"), "domain_score": (13, "double"), "hmm_from": (15, "int"), "hmm_to": (16, "int"),
    "alignment_from": (17, "int"), "alignment_to": (18, "int"), "envelope_from": (19, "int"), "envelope_to": (20, "int"), "accuracy": (21, "double"),
}


def domain_hits(spark: SparkSession, path: str) -> DataFrame:
    """Domain hits of white-space separated lines of 22 fields and a description."""
    cells = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+", 23).alias("c")).where(F.size("c") >= 22)
    version = F.split_part(F.col("c")[1], F.lit("."), F.lit(1))
    accession = F.when(F.col("c")[1] == "-", F.col("c")[0]).otherwise(version)
    return cells.select(*[F.col("c")[i].cast(t).alias(n) for n, (i, t) in DOMAIN_FIELDS.items()], accession.alias("pfam_accession"), F.coalesce(F.get("c", F.lit(22)), F.lit("")).alias("description"))


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms (id, name, namespace), alternatives (alt_id, id)) of an OBO file, without obsolete terms."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).where(F.ltrim("value", F.lit("\n")).startswith("[Term]"))
    field = lambda k: F.regexp_extract("value", rf"(?m)^{k}:\s*(.*?)\s*$", 1)
    live = stanzas.where(field("is_obsolete") != "true").withColumns({"id": field("id"), "name": field("name"), "namespace": field("namespace")}).where("id <> ''")
    alternatives = live.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^alt_id:\s*(\S+)"), F.lit(1))).alias("alt_id"), "id")
    return live.select("id", "name", "namespace"), alternatives


def coding_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows of type CDS of a GFF3 file, plain or compressed, with their attributes as a map."""
    columns = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"
    rows = spark.read.schema(columns).option("sep", "\t").option("comment", "#").option("quote", "").csv(path).where("type = 'CDS'")
    pairs = F.transform(F.filter(F.split("attributes", ";"), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.split(p, "=", 2)[1]))
    return rows.withColumn("attrs", F.map_from_entries(F.array_distinct(pairs))).drop("attributes")


def quantification(spark: SparkSession, path: str) -> DataFrame:
    columns = "Name string, Length double, EffectiveLength double, TPM double, NumReads double"
    return spark.read.schema(columns).option("sep", "\t").option("header", True).csv(path)


def documents_json(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, json, doc): whole files as variants, null where malformed."""
    rows = spark.read.options(**options).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"), F.try_parse_json("value").alias("doc"))


def completeness_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, complete, single, duplicated, fragmented, missing, n) from short summaries; null where not stated."""
    text = F.regexp_replace("value", " ", "")
    pattern = r"C:([0-9.]+)%\[S:([0-9.]+)%,D:([0-9.]+)%\],F:([0-9.]+)%,M:([0-9.]+)%,n:([0-9]+)"
    part = lambda i: finite(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")))
    rows = spark.read.text(path, wholetext=True)
    names = ("complete", "single", "duplicated", "fragmented", "missing")
    return rows.select(F.col("_metadata.file_path").alias("path"), *[part(i + 1).alias(n) for i, n in enumerate(names)], part(6).cast("int").alias("n"))


# What a tree program's report says, by pattern.
TREE_REPORT = {
    "best_model": r"Best-fit model[^:]*:\s*(\S+)", "log_likelihood": r"Log-likelihood of the tree:\s*(-?[0-9.]+)", "alignment_sequences": r"Input data:\s*([0-9]+) sequences",
    "alignment_sites": r"sequences with ([0-9]+)", "cpu_time": r"Total CPU time used:\s*(.+)", "wall_time": r"Total wall-clock time used:\s*(.+)",
}


def tree_reports(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), *[F.nullif(F.trim(F.regexp_extract("value", p, 1)), F.lit("")).alias(n) for n, p in TREE_REPORT.items()])


def markers(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(folder, value): files of one value, by the folder they lie in."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("value"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, modified) of every file below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def manifest_row(df: DataFrame, index: int, column: str = "array_index") -> dict:
    """The one row of a manifest with an index; it must be just one."""
    found = df.where(F.col(column) == index).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} rows have {column} {index}")
    return found[0].asDict()


def elapsed_seconds(x: Column) -> Column:
    """Seconds of [days-]hours:minutes:seconds."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(x, r"^(?:(\d+)-)?(\d+):(\d+):(\d+)$", i), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(F.rlike(x, F.lit(r"^(\d+-)?\d+:\d+:\d+$")), ((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4))


def sqlite_table(spark: SparkSession, source: str | sqlite3.Connection, sql: str, schema: str, rows: int = 50_000) -> DataFrame:
    """Rows of a query over an SQLite file that the driver can open, or over an
    open connection, staged as Parquet in the shared folder, ``rows`` at a time."""
    target = place(spark, "sqlite")
    spark.createDataFrame([], schema).write.parquet(target)
    with source if isinstance(source, sqlite3.Connection) else sqlite3.connect(f"file:{source}?mode=ro", uri=True) as db:
        found = db.execute(sql)
        while part := found.fetchmany(rows):
            spark.createDataFrame(part, schema).write.mode("append").parquet(target)
    return spark.read.parquet(target)
