"""Selection of isoforms, species and families, with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.numbers import ratio
from quarrystone.functions.text import gene_key, reasons
from quarrystone.operators import sinks


def longest_isoforms(records: DataFrame) -> DataFrame:
    """(species, gene_key, rule, kept, length, isoforms) from (species, id, header, seq): the longest of each gene, then the larger id."""
    key, rule = gene_key(F.col("header"), F.col("id"))
    rows = records.select("species", "id", F.length("seq").alias("length"), key.alias("gene_key"), rule.alias("rule"))
    best = F.max(F.struct("length", "id")).alias("_best")
    return rows.groupBy("species", "gene_key").agg(F.min("rule").alias("rule"), best, F.count("*").alias("isoforms")).select(
        "species", "gene_key", "rule", F.col("_best.id").alias("kept"), F.col("_best.length").alias("length"), "isoforms"
    )


def longest_per(df: DataFrame, by: list[str], seq: str, ident: str) -> DataFrame:
    """(by, longest, ident): the longest sequence of each group without its stops, then the larger id."""
    length = F.length(F.replace(seq, F.lit("*"), F.lit(""))).cast("bigint")
    return df.groupBy(*by).agg(F.max(length).alias("longest"), F.max_by(ident, F.struct(length, F.col(ident))).alias(ident))


def rule_counts(isoforms: DataFrame) -> DataFrame:
    """(species, rules): how many genes each rule named, as rule:n joined by semicolons."""
    counts = isoforms.groupBy("species", "rule").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "rule", F.col("n").cast("string"))))
    return counts.groupBy("species").agg(F.array_join(pairs, ";").alias("rules"))


def core_set(summary: DataFrame, least: float = 80.0, least_core: int = 0) -> DataFrame:
    """(species, complete_pct, analysis_role, reason); fails with fewer than ``least_core`` core species."""
    good = F.col("complete_pct") >= least
    text = F.concat(F.lit("BUSCO complete "), F.format_string("%.1f", "complete_pct"), F.when(good, "% >= ").otherwise("% < "), F.lit(f"{least:.1f}%"))
    out = summary.select("species", "complete_pct", F.when(good, "core").otherwise("supplementary").alias("analysis_role"), text.alias("reason"))
    if least_core and out.where("analysis_role = 'core'").count() < least_core:
        raise ValueError(f"fewer than {least_core} species pass {least}")
    return out


def write_core(rows: DataFrame, core: DataFrame, path: str, least_core: int = 1) -> int:
    """Writes the ``rows`` (species, …) of the core species of ``core_set``, a
    folder each, and nothing if fewer than ``least_core`` are core; how many rows."""
    names = core.where("analysis_role = 'core'").select("species")
    enough = names.agg((F.count("*") >= least_core).alias("ok"))
    kept = sinks.required(rows.join(names, "species", "left_semi"), enough, f"fewer than {least_core} core species")
    return sinks.observed_write(kept, path, {"n": F.count("*")}, "species")["n"]


def eligible(sequences: Column, species: Column, unique: Column, least: tuple[int, int, int] = (4, 3, 3)) -> tuple[Column, Column]:
    """Whether a family has enough to build a tree, and why not."""
    why = reasons((sequences < least[0], "too_few_strict_sequences"), (species < least[1], "too_few_species"), (unique < least[2], "too_few_unique_sequences"))
    return why == "", why


def selection_score(evidence: Column, change: Column, species: Column, direct: Column, review: Column, kept: Column, original: Column) -> Column:
    """Evidence plus change, species and direct domains, less what is under review or excluded."""
    n, all_ = F.greatest(kept, F.lit(1)), F.greatest(original, F.lit(1))
    return evidence + F.least(F.abs(change), F.lit(100.0)) * 0.10 + species * 2.0 + ratio(direct, n) * 10.0 - ratio(review, n) * 4.0 - ratio(all_ - kept, all_) * 3.0


def availability(species: DataFrame, libraries: DataFrame, mismatched: DataFrame) -> DataFrame:
    """(grp, species, status, accession) of (grp, species) with (species, accession): matched, unmatched, and libraries of other taxa, which are listed and never used."""
    got = species.join(libraries, "species", "left")
    status = F.when(F.col("accession").isNotNull(), "available_single_library").otherwise("unavailable")
    rows = got.select("grp", "species", status.alias("status"), F.coalesce("accession", F.lit("")).alias("accession"))
    other = mismatched.select(F.lit("supplementary_not_integrated").alias("grp"), "species", F.lit("available_taxon_mismatch").alias("status"), "accession")
    return rows.unionByName(other)


def run_status(selected: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Selected rows with ``status`` from the markers found: failed, complete or missing."""
    rows = selected.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left").join(failed.select(key, F.lit(True).alias("_failed")).distinct(), key, "left")
    return rows.withColumn("status", F.when(F.col("_failed"), "failed").when(F.col("_done"), "complete").otherwise("missing")).drop("_done", "_failed")


def status_summary(rows: DataFrame, by: str) -> DataFrame:
    """Families of each group, and how many are complete, failed or missing."""
    return rows.groupBy(by).agg(F.count("*").alias("families"), *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "failed", "missing")])


def ranges_or_zero(df: DataFrame, every: DataFrame, by: str, value: str) -> DataFrame:
    """(by, smallest, largest) of every group, 0 where ``df`` has no row of it."""
    got = df.groupBy(by).agg(F.min(value).alias("smallest"), F.max(value).alias("largest"))
    return every.join(got, by, "left").na.fill(0, ["smallest", "largest"])
