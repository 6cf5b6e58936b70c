"""Record checks: flags with severities, duplicate groups, entropy, expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.functions.arrays import letter_counts
from quarrystone.functions.stats import places, shannon_bits
from quarrystone.functions.tails import let

# Statuses by severity.
SEVERITY = ("pass", "review", "review_high", "exclude_recommended")


def flagged(df: DataFrame, flags: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """``flags`` (names in order) and ``status``: the worst severity of those that hold."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in flags]))
    worst = F.greatest(F.lit(0), *[F.when(c, F.lit(s)).otherwise(0) for _, c, s in flags])
    return df.withColumns({"flags": names, "status": F.get(F.array(*map(F.lit, SEVERITY)), worst)})


def risks(df: DataFrame, text: Column, patterns: Mapping[str, str]) -> DataFrame:
    return df.withColumn("risks", F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(n)) for n, p in patterns.items()])))


def with_length_ratio(df: DataFrame, family: str, length: str) -> DataFrame:
    """``family_size``, ``family_median`` and ``length_ratio``. The median comes by aggregation and a join, so no family is
    gathered in one task; the few rows of it are written, so that the join is planned by their size."""
    stats = written(df.groupBy(family).agg(F.median(length).alias("family_median"), F.count("*").alias("family_size")), "medians")
    return df.join(stats, family).withColumn("length_ratio", F.try_divide(F.col(length), F.col("family_median")))


def duplicate_context(groups: GroupedData, *more: Column) -> DataFrame:
    """(digest, members, context, …) of rows (digest, family, species) grouped by digest."""
    got = groups.agg(F.count("*").alias("members"), F.countDistinct("species").alias("_s"), F.countDistinct("family").alias("_f"), *more)
    context = F.when(F.col("_f") > 1, "cross_orthogroup").when(F.col("_s") == 1, "within_species_family").otherwise("cross_species_family")
    return got.withColumn("context", context).drop("_s", "_f")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(duplicate_group, digest, members, context, first): groups of two or more
    rows (digest, family, species, item) with one digest, numbered by digest,
    and their smallest item. Members are a table of their own (``duplicate_members``)."""
    got = duplicate_context(df.groupBy("digest"), F.min("item").alias("first")).where("members >= 2")
    return places(got, "digest").withColumn("duplicate_group", F.concat(F.lit("DUP"), F.lpad(F.col("place").cast("string"), 6, "0"))).drop("place")


def duplicate_members(df: DataFrame, groups: DataFrame) -> DataFrame:
    """(duplicate_group, item): a row per member, however many a group has."""
    return df.join(groups.select("digest", "duplicate_group"), "digest").select("duplicate_group", "item")


def repeated(df: DataFrame, ident: str) -> DataFrame:
    """(ident, n) of ids that occur more than once."""
    return df.groupBy(ident).agg(F.count("*").alias("n")).where("n > 1")


def entropy(text: Column, letters: str) -> Column:
    """Entropy in bits of the ``letters`` of a text, counted inside the row; null if it has none of them."""
    return let(text, lambda t: let(letter_counts(t, letters), shannon_bits))


def expression_bin(tpm: Column) -> Column:
    return F.when(tpm == 0, "undetected").when(tpm < 0.1, "trace").when(tpm < 1, "low").when(tpm < 10, "moderate").otherwise("high")


def rollup(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, detected: float) -> DataFrame:
    """Two levels of sums: counts, detected ones, total and largest of each inner group, then of each outer one."""
    a = df.groupBy(*inner).agg(F.count("*").alias("copies"), F.count_if(F.col(value) >= detected).alias("detected"), F.sum(value).alias("total"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return a.groupBy(*outer).agg(
        F.count("*").alias("groups"), F.count_if(F.col("detected") > 0).alias("detected_groups"), F.sum("copies").alias("copies"),
        F.sum("detected").alias("detected"), F.sum("total").alias("total"), F.max("most").alias("most"), F.avg("mean").alias("mean"),
    )


def detection(df: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """(by, threshold, detected): all thresholds in one pass."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(value) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("detected")) for i, t in enumerate(thresholds)])
    return counts.select(*by, F.inline(rows))


def support_class(label: Column) -> Column:
    """Support of a node label a/b: both strong, either, moderate, unknown, low."""
    a = F.regexp_extract(label, r"^\s*([0-9.]+)\s*/", 1).try_cast("double")
    b = F.regexp_extract(label, r"/\s*([0-9.]+)\s*$", 1).try_cast("double")
    yes = lambda c: F.coalesce(c, F.lit(False))
    strong_a, strong_b = yes(a >= 80), yes(b >= 95)
    return (
        F.when(a.isNull() & b.isNull(), "unknown")
        .when(strong_a & strong_b, "strong")
        .when(strong_a | strong_b, "partial_strong")
        .when(yes(a >= 60) | yes(b >= 70), "moderate")
        .otherwise("low")
    )


# Ancestors that name a lineage, in order of preference.
LINEAGES = (
    (10239, "virus"), (2, "bacteria"), (2157, "archaea"), (33208, "metazoa"), (4751, "fungi"), (33090, "viridiplantae"),
    (33630, "alveolata"), (33634, "stramenopiles"), (2759, "other_eukaryote"),
)


def lineage(track: Column) -> Column:
    """The first of the known lineages among comma-separated ancestors, else unknown."""
    ids, out = F.split(F.coalesce(track, F.lit("")), r"\s*,\s*"), F.lit("unknown")
    for taxon, name in reversed(LINEAGES):
        out = F.when(F.array_contains(ids, str(taxon)), name).otherwise(out)
    return out
