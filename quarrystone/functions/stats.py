"""Statistics over DataFrames: ranks, false discovery rates, tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.functions.tails import two_sided_normal, two_sided_student


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in the shared folder, dealt out by ranges of ``order``: with
    ``_part``, the number of a row's range, and ``_at``, its place in it from 0.

    Ranges follow what the order's columns hold, ties included; a value that
    most rows share is split by the columns after it.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}), "ranges")


_dealt = in_ranges


def _running(dealt: DataFrame, by: Sequence[str], value: str, order: Column | str, n: str) -> DataFrame:
    """``dealt`` rows of distinct (by, value) with ``_upto``, the sum of ``n`` over
    the rows of their group up to them, and ``_all``, that over the group.

    A window inside each range of a group, and one over a row per group and
    range: no task gets a whole group.
    """
    own = [F.col(c) for c in by]
    sizes = dealt.groupBy(*by, "_part").agg(F.sum(n).alias("_n"))
    whole = Window.partitionBy(*own)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_all"))
    match = F.col("_part") == F.col("_p")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.sum(n).over(Window.partitionBy(*own, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", inside).join(starts, match).withColumn("_upto", F.col("_start") + F.col("_in")).drop("_in", "_start", "_p", *[f"_{c}" for c in by])


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``df``, read twice, with the adjusted p-values as ``out``, null where p is null or not finite.

    Of sorted p, q_i is the smallest p_j m / j over j >= i, at most 1, within
    groups if there are any. Equal p have one q, that of their last place, so
    all is done on distinct values with counts, in ranges of the value, and
    joined back: neither ties nor a large group make a large task.
    """
    good = F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    counts = df.where(good).groupBy(*by, p).agg(F.count("*").alias("_n"))
    ranked = _running(in_ranges(counts, *by, p), by, p, F.col(p), "_n").withColumn("_q", F.col(p) * F.col("_all") / F.col("_upto"))
    own = [F.col(c) for c in by]
    least = ranked.groupBy(*by, "_part").agg(F.min("_q").alias("_least"))
    after = Window.partitionBy(*own).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later = least.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), F.min("_least").over(after).alias("_later"))
    match = F.col("_part") == F.col("_p")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.min("_q").over(Window.partitionBy(*own, "_part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    done = ranked.withColumn("_in", inside).join(later, match)
    adjusted = done.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(p).alias("_value"), F.least(F.lit(1.0), F.col("_in"), F.coalesce("_later", F.lit(1.0))).alias(out))
    same = F.col(p) == F.col("_value")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(adjusted, same, "left").drop("_value", *[f"_{c}" for c in by])


def places(df: DataFrame, *order: Column | str, out: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 in the whole table by ``order``,
    which must not tie: sorted in ranges, whose sizes are added up."""
    rows = in_ranges(df, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn(out, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def group_places(df: DataFrame, by: Sequence[str], *order: Column | str, out: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 in its group by ``order``, which must
    not tie: the place in the whole table less those of the groups before, so
    that no group is numbered in one task."""
    ranked = places(df, *by, *order, out="_place")
    first = ranked.groupBy(*by).agg((F.min("_place") - 1).alias("_before")).select(*[F.col(c).alias(f"_{c}") for c in by], "_before")
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranked.join(first, match).withColumn(out, F.col("_place") - F.col("_before")).drop("_place", "_before", *[f"_{c}" for c in by])


def running_max(df: DataFrame, by: Sequence[str], value: Column, *order: Column | str, out: str, before: bool = False) -> DataFrame:
    """``df`` with the largest ``value`` of its group up to each row by ``order``
    (if ``before``, of the rows before it; null at a group's first): inside ranges of the order, and beyond them by what the
    ranges before hold (a row per group and range)."""
    rows = in_ranges(df.withColumn("_v", value), *by, *order)
    own = [F.col(c) for c in by]
    most = rows.groupBy(*by, "_part").agg(F.max("_v").alias("_most"))
    earlier = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = most.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), F.max("_most").over(earlier).alias("_carried"))
    match = F.col("_part") == F.col("_p")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.max("_v").over(Window.partitionBy(*own, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    joined = rows.withColumn("_in", inside).join(carried, match)
    return joined.withColumn(out, F.greatest("_in", "_carried")).drop("_v", "_part", "_at", "_in", "_p", "_carried", *[f"_{c}" for c in by])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the fractional rank of ``value`` in its group: ties share the
    mean of their places. Ranks come from the counts of distinct values, added
    up in ranges of the value, and are joined back; null values have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = _running(in_ranges(counts, *by, value), by, value, F.col(value), "_n")
    names = {c: f"_of_{c}" for c in [*by, value]}
    found = ranked.select(*[F.col(c).alias(n) for c, n in names.items()], (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    same = F.col(value) == F.col(names[value])
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(names[c]))
    return df.join(found, same, "left").drop(*names.values())


def pearson(x: Column, y: Column) -> Column:
    """An aggregate: the correlation, NaN for fewer than two rows or no variance."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = F.sum(x * y) - sx * sy / n
    var = (F.sum(x * x) - sx * sx / n) * (F.sum(y * y) - sy * sy / n)
    return F.when((n < 2) | (var <= 1e-12), F.lit(float("nan"))).otherwise(F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))))


def fold_enrichment(hits: Column, drawn: Column, marked: Column, population: Column) -> Column:
    return F.try_divide(hits / drawn, marked / population)


def haldane_odds(hits: Column, drawn: Column, marked: Column, population: Column) -> Column:
    """Odds ratio with half a count added to each cell."""
    a, b, c = hits, drawn - hits, marked - hits
    d = population - drawn - c
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def shannon_bits(counts: Column) -> Column:
    """Entropy in bits of an array of counts; null if they are all 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n)
    terms = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total) - terms / total))


def rank_sum_test(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """One row: W of the first sample, the corrected z and two-sided p of the rank-sum test.

    Normal approximation with continuity correction and tie correction. Ranks
    come from counts of the distinct values, not from sorting all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"), F.sum(is_first.cast("bigint")).alias("_a"))
    ranked = _running(in_ranges(counts, value), [], value, F.col(value), "_n").withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2.0)
    s = ranked.agg(
        F.sum(F.col("_a") * F.col("_rank")).alias("r"), F.sum("_a").cast("double").alias("a"), F.sum("_n").cast("double").alias("n"),
        F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("ties"),
    )
    a, n = F.col("a"), F.col("n")
    b = n - a
    w = F.col("r") - a * (a + 1) / 2
    sd = F.sqrt(F.try_divide(a * b, F.lit(12.0)) * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    centred = w - a * b / 2
    z = F.try_divide(centred - F.signum(centred) * 0.5, sd)
    return s.select(w.alias("w"), z.alias("z")).withColumn("p_value", two_sided_normal("z"))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho of average ranks, and its two-sided p by Student's t."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(rows, [], x, f"_{x}_rank"), [], y, f"_{y}_rank")
    got = ranked.agg(F.count("*").cast("double").alias("n"), pearson(F.col(f"_{x}_rank"), F.col(f"_{y}_rank")).alias("rho"))
    rest = F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0))
    t = F.when(rest == 0, F.lit(float("inf"))).otherwise(F.col("rho") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0.0))) / F.sqrt(F.greatest(rest, F.lit(1e-300))))
    return got.withColumn("t", t).select("n", "rho", two_sided_student("t", F.col("n") - 2).alias("p_value"))


def described_share(df: DataFrame, metric: Column, count: Column, of: Column) -> DataFrame:
    """(metric, fraction, p_value): shares that are stated without a test, so p is null."""
    return df.select(metric.alias("metric"), F.try_divide(count.cast("double"), of.cast("double")).alias("fraction"), F.lit(None).cast("double").alias("p_value"))
