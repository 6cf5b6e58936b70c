"""Checks of sequences: residues, length, duplicates, domains, origin and function, as flags with severities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.validation import SEVERITY, duplicate_context

# Residues that a sequence may hold, those that say nothing, patterns of doubtful functions and terms of one of them.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYBXZJUO*"
UNKNOWN = "XBZJ"
RISKS = {
    "plastid_or_photosynthesis": r"(?i)chloroplast|plastid|photosystem|chlorophyll|light[- ]harvest|rubisco|ribulose[- ]?bisphosphate carboxylase|phycobil",
    "transposable_element": r"(?i)reverse transcript|retrotrans|transposase|transposable element|retroviral|gag[- ]?pol|\bRVT[_-]|\bDDE[_-]?Tnp|integrase core",
    "viral_or_phage": r"(?i)viral|virus|virion|capsid|bacteriophage|\bphage\b",
}
PLASTID_TERMS = ("GO:0009507", "GO:0009536", "GO:0009526", "GO:0015979", "GO:0019684")
FOREIGN, NOT_ANIMAL = ("bacteria", "archaea", "virus"), ("fungi", "viridiplantae", "alveolata", "stramenopiles", "other_eukaryote")


def unknown_share(seq: Column) -> Column:
    """Share of residues that say nothing; 1 for an empty sequence."""
    unknown = F.length(F.regexp_replace(seq, f"[^{UNKNOWN}]+", ""))  # by runs; translate looks every character up
    return F.when(F.length(seq) > 0, unknown / F.length(seq)).otherwise(1.0)


def invalid_residues(seq: Column) -> Column:
    """The distinct characters that are no residue, sorted."""
    rest = F.regexp_replace(seq, f"[{RESIDUES}]+", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda c: c != "")))


def inner_stop(seq: Column) -> Column:
    at = F.instr(seq, "*")
    return (at > 0) & (at < F.length(seq))


def end_stop(seq: Column) -> Column:
    return seq.endswith("*")


def risk_categories(text: Column, go_terms: Column) -> Column:
    """Names of the doubtful functions that the text speaks of, sorted; terms of plastids count as well."""
    plastid = F.arrays_overlap(F.transform(F.split(F.coalesce(go_terms, F.lit("")), ","), lambda t: F.trim(t)), F.array(*map(F.lit, PLASTID_TERMS)))
    found = [F.when(F.rlike(text, F.lit(p)) | (plastid if n.startswith("plastid") else F.lit(False)), F.lit(n)) for n, p in RISKS.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def _first(*cases: tuple[Column, str, str]) -> Column:
    """A flag (name, severity) of the first case that holds."""
    out = F.lit(None).cast("struct<name:string,severity:int>")
    for condition, name, severity in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), _flag(F.lit(name), severity)).otherwise(out)
    return out


def _flag(name: Column, severity: str) -> Column:
    return F.struct(name.alias("name"), F.lit(SEVERITY.index(severity)).alias("severity"))


def marks(seq: Column) -> dict[str, Column]:
    """What ``flags`` needs to know of a sequence itself, by name: a few numbers in place of the letters."""
    return {"length": F.length(seq), "foreign": F.size(invalid_residues(seq)), "inner_stop": inner_stop(seq), "end_stop": end_stop(seq), "unknown": unknown_share(seq)}


def flags() -> Column:
    """All flags of a row, in order, over the columns of ``marks``, bits (entropy), family_size, length_ratio, duplicate
    (its context or null), n_with_domains, domain_rich, n_hits, n_core, core_jaccard, lineage and risks."""
    c, n = F.col, F.col("length")
    family = c("family_size") >= 5
    single = [
        _first((n < 30, "very_short_lt30aa", "exclude_recommended"), (n < 50, "short_lt50aa", "review_high"), (n < 100, "short_lt100aa", "review")),
        _first((c("foreign") > 0, "invalid_amino_acid_characters", "exclude_recommended")),
        _first((c("inner_stop"), "internal_stop_codon", "exclude_recommended")),
        _first((c("end_stop"), "terminal_stop_symbol", "review")),
        _first((c("unknown") > 0.05, "ambiguous_residue_fraction_gt5pct", "review")),
        # Four letters as often as each other have 2 bits exactly, which the logarithms may miss by their last bit.
        _first(((F.round("bits", 9) < 2.0) & (n >= 50), "low_sequence_complexity", "review")),
        _first((family & (c("length_ratio") < 0.50), "severe_short_length_outlier", "review_high"), (family & (c("length_ratio") < 0.67), "moderate_short_length_outlier", "review")),
        _first((family & (c("length_ratio") > 2.0), "severe_long_length_outlier", "review")),
        F.when(c("duplicate") == "cross_orthogroup", _flag(F.concat(F.lit("exact_duplicate_"), c("duplicate")), "review_high")).when(
            c("duplicate").isNotNull(), _flag(F.concat(F.lit("exact_duplicate_"), c("duplicate")), "review")
        ),
        _first(((c("n_with_domains") >= 3) & (c("domain_rich") >= 0.70) & (c("n_hits") == 0), "missing_domain_in_domain_rich_family", "review")),
        _first(((c("n_core") > 0) & (c("n_hits") > 0) & (c("core_jaccard") < 0.25), "direct_domain_architecture_outlier", "review")),
        F.when(c("lineage").isin(*FOREIGN), _flag(F.concat(F.lit("seed_taxonomy_"), c("lineage")), "exclude_recommended")).when(
            c("lineage").isin(*NOT_ANIMAL), _flag(F.concat(F.lit("non_metazoan_seed_"), c("lineage")), "review_high")
        ),
    ]
    doubts = F.transform("risks", lambda r: _flag(F.concat(F.lit("functional_risk_"), r), "review_high"))
    return F.concat(F.array_compact(F.array(*single)), doubts)


def validated(df: DataFrame) -> DataFrame:
    """``df`` (see ``flags``) with ``flags`` (their names) and ``status``, the worst severity."""
    rows = df.withColumn("_flags", flags())
    worst = F.coalesce(F.array_max(F.transform("_flags", lambda f: f["severity"])), F.lit(0))
    return rows.withColumns({"flags": F.transform("_flags", lambda f: f["name"]), "status": F.get(F.array(*map(F.lit, SEVERITY)), worst)}).drop("_flags")


def with_duplicates(df: DataFrame) -> DataFrame:
    """``df`` (digest, species, family) with ``duplicate``, the context of its group of two or more equal digests, and ``copies``."""
    groups = duplicate_context(df.groupBy("digest")).where("members >= 2").select("digest", F.col("context").alias("duplicate"), F.col("members").alias("copies"))
    return df.join(groups, "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


def domain_stats(items: DataFrame, hits: DataFrame) -> DataFrame:
    """(family, family_size, n_with_domains, domain_rich) of (family, item) and distinct (family, item, term)."""
    n = items.groupBy("family").agg(F.count("*").alias("family_size"))
    k = hits.select("family", "item").distinct().groupBy("family").agg(F.count("*").alias("n_with_domains"))
    out = n.join(k, "family", "left").withColumn("n_with_domains", F.coalesce("n_with_domains", F.lit(0)))
    return out.withColumn("domain_rich", F.col("n_with_domains") / F.col("family_size"))


def family_review(checked: DataFrame) -> DataFrame:
    """A row per family of (family, status, flags, risks, lineage): statuses, doubts, origins, outliers and the priority for review."""
    status = lambda s: F.count_if(F.col("status") == s)
    risk = lambda r: F.count_if(F.array_contains("risks", r)).alias(f"{r}_flags")
    got = checked.groupBy("family").agg(
        status("pass").alias("pass_sequences"), status("review").alias("review_sequences"), status("review_high").alias("review_high_sequences"), status("exclude_recommended").alias("exclude_sequences"),
        F.count_if(F.array_contains("flags", "direct_domain_architecture_outlier")).alias("outliers"), *map(risk, RISKS),
        F.count_if(F.col("lineage") == "metazoa").alias("metazoan"), F.count_if(~F.col("lineage").isin("metazoa", "unassigned")).alias("non_metazoan"),
    )
    return got.withColumn("priority", 100 * F.col("exclude_sequences") + 10 * F.col("review_high_sequences") + F.col("review_sequences"))


def high_risk(df: DataFrame) -> DataFrame:
    """Rows of high or highest severity, of a doubtful function, or of an origin that is known and no animal."""
    return df.where(F.col("status").isin("review_high", "exclude_recommended") | (F.size("risks") > 0) | ~F.col("lineage").isin("metazoa", "unassigned"))


def strict(df: DataFrame, statuses: Sequence[str] = ("pass", "review")) -> DataFrame:
    return df.where(F.col("status").isin(*statuses))
