"""Occupancy of families over species: categories, row statistics, routing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.numbers import ratio

# Categories in their order of report.
CATEGORIES = ("universal_single_copy", "universal_multicopy", "near_core", "shell", "species_specific")


def classify(present: Column, all_single: Column, species: int, near_core: float = 0.80) -> Column:
    """Category of a family from how many of ``species`` hold it and whether all hold one copy."""
    return (
        F.when((present == species) & all_single, CATEGORIES[0])
        .when(present == species, CATEGORIES[1])
        .when(present >= math.ceil(near_core * species), CATEGORIES[2])
        .when(present == 1, CATEGORIES[4])
        .otherwise(CATEGORIES[3])
    )


def row_stats(copies: DataFrame, species: Sequence[str], family: str = "family", by: str = "species", n: str = "n", high: int = 100) -> DataFrame:
    """A row per family of the long table (family, species, n > 0): category,
    presence, totals, mean and median over all ``species``, and the species
    with most copies, joined by semicolons. Absent species count as 0."""
    s, total, present = len(species), F.sum(n), F.count_if(F.col(n) > 0)
    most = F.max(n)
    list_of = F.array_sort(F.collect_list(F.struct(F.col(by).alias("s"), F.col(n).alias("n"))))
    got = copies.where(F.col(n) > 0).groupBy(family).agg(
        present.alias("present"), total.cast("bigint").alias("total"), most.cast("bigint").alias("most"), F.bool_and(F.col(n) == 1).alias("_single"), list_of.alias("_list")
    )
    counts = F.array_sort(F.concat(F.transform("_list", lambda x: x["n"].cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), F.lit(s) - F.col("present").cast("int"))))
    median = (F.get(counts, F.lit((s - 1) // 2)) + F.get(counts, F.lit(s // 2))) / 2.0
    top = F.filter("_list", lambda x: x["n"] == F.col("most"))
    return got.select(
        family,
        classify(F.col("present"), F.col("_single"), s).alias("category"),
        F.col("present").cast("bigint").alias("present"),
        (F.col("present") / s).alias("occupancy"),
        "total",
        (F.col("total") / s).alias("mean_all"),
        median.alias("median_all"),
        "most",
        F.array_join(F.transform(top, lambda x: x["s"]), ";").alias("most_species"),
        (F.col("total") / F.col("present")).alias("mean_present"),
        (F.col("most") > 1).alias("duplicated"),
        (F.col("most") >= high).alias("high_copy"),
    )


def category_summary(stats: DataFrame) -> DataFrame:
    """Families and copies of each category, all five listed, with their shares in percent."""
    dim = stats.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    counts = stats.groupBy("category").agg(F.count("*").alias("families"), F.sum("total").alias("copies"))
    every = Window.partitionBy()  # five rows
    filled = dim.join(counts, "category", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("families", "copies")})
    share = lambda c: F.round(100 * ratio(F.col(c), F.sum(c).over(every)), 6)
    return filled.select("category", "families", share("families").alias("percent_families"), "copies", share("copies").alias("percent_copies"))


def comma_items(cell: Column) -> Column:
    """How many items a cell lists that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x) != "")).cast("bigint")


def group_summary(stats: DataFrame, by: str) -> DataFrame:
    """A row per group: its families, their copies, and a count of each category."""
    return stats.groupBy(by).agg(F.count("*").alias("families"), F.sum("total").alias("copies"), *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def class_presence(copies: DataFrame, in_first: Column, names: tuple[str, str], family: str = "family", n: str = "n") -> DataFrame:
    """Copies and species of each family in two classes of species, and whether it is shared."""
    first, second = names
    got = copies.where(F.col(n) > 0).groupBy(family).agg(
        F.sum(F.when(in_first, F.col(n)).otherwise(0)).cast("bigint").alias(f"{first}_copies"),
        F.count_if(in_first).cast("bigint").alias(f"{first}_species"),
        F.sum(F.when(in_first, 0).otherwise(F.col(n))).cast("bigint").alias(f"{second}_copies"),
        F.count_if(~in_first).cast("bigint").alias(f"{second}_species"),
        F.max(n).cast("bigint").alias("most"),
    )
    a, b = F.col(f"{first}_species") > 0, F.col(f"{second}_species") > 0
    return got.withColumn("presence", F.when(a & b, "shared_between_classes").when(a, f"{first}_only").otherwise(f"{second}_only"))


def class_summary(presence: DataFrame, names: tuple[str, str]) -> DataFrame:
    a, b = names
    return presence.groupBy("presence").agg(
        F.count("*").alias("families"), F.sum(F.col(f"{a}_copies") + F.col(f"{b}_copies")).alias("copies"), F.count_if(F.col("most") > 1).alias("duplicated_families")
    )


def route(presence: DataFrame, names: tuple[str, str], largest: int = 99) -> DataFrame:
    """root_absent if either side of the root lacks the family, large above ``largest`` copies in one species, else primary."""
    a, b = names
    absent = (F.col(f"{a}_copies") == 0) | (F.col(f"{b}_copies") == 0)
    return presence.withColumn("route", F.when(absent, "root_absent").when(F.col("most") > largest, "large").otherwise("primary"))


def to_wide(copies: DataFrame, species: Sequence[str], family: str = "family", by: str = "species", n: str = "n") -> DataFrame:
    """A column of counts per species, 0 where absent, and their total."""
    wide = copies.groupBy(family).pivot(by, list(species)).agg(F.sum(n)).na.fill(0)
    return wide.withColumn("total", sum((F.col(s) for s in species), F.lit(0)).cast("bigint"))


def to_long(wide: DataFrame, species: Sequence[str], family: str = "family") -> DataFrame:
    return wide.unpivot(family, list(species), "species", "n")


def total_mismatch(wide: DataFrame, species: Sequence[str]) -> DataFrame:
    """Rows whose stated total is not the sum of their counts."""
    return wide.where(F.col("total") != sum((F.col(s) for s in species), F.lit(0)))


def assignment(assigned: DataFrame, everything: DataFrame, by: str = "species") -> DataFrame:
    """(by, assigned, unassigned, total, rate in percent) from two tables (by, n)."""
    got = everything.withColumnRenamed("n", "total").join(assigned.withColumnRenamed("n", "assigned"), by, "left")
    a = F.coalesce("assigned", F.lit(0))
    return got.select(by, a.cast("bigint").alias("assigned"), (F.col("total") - a).cast("bigint").alias("unassigned"), F.col("total").cast("bigint").alias("total"), F.round(100 * ratio(a, F.col("total")), 6).alias("rate_percent"))
