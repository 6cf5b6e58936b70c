"""Selections and ranks: one per group, caps, quotas, labels and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.stats import group_places, places, running_max

#: Slices of a group whose first rows are found on their own before they are merged.
_SLICES = 32


def best_per(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return top_per(df, by, 1, *order).drop("place")


def top_per(df: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, numbered by ``place``.

    A bounded top-k that merges: the first ``k`` of each group and ``_SLICES``
    slices of its rows, then the first of these. However large a group is, a
    task sorts a slice of it or ``k * _SLICES`` rows, and up to a ``k`` of 1000
    Spark keeps no more than ``k`` rows of a group in a task before it shuffles.
    """
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*hashed), F.lit(_SLICES)))
    some = dealt.withColumn("place", number(*by, "_slice")).where(F.col("place") <= k).drop("_slice", "place")
    return some.withColumn("place", number(*by)).where(F.col("place") <= k)


def capped(df: DataFrame, inner: Sequence[str], outer: Sequence[str], per_inner: int, per_outer: int, *order: Column) -> DataFrame:
    """At most ``per_inner`` rows of each inner group and then ``per_outer`` of each outer one."""
    return top_per(top_per(df, inner, per_inner, *order).drop("place"), outer, per_outer, *order)


def quota(df: DataFrame, by: Sequence[str], wanted: Column, least: int, total: int, first: Sequence[Column], final: Sequence[Column]) -> DataFrame:
    """``total`` rows of each group, of which up to ``least`` are wanted ones:
    these are taken first, the rest by order, and all are numbered anew.

    All that can be chosen are the first ``total`` wanted rows and the first
    ``total`` others; these two bounded sets are found first (see ``top_per``).
    """
    some = top_per(df.withColumn("_wanted", F.coalesce(wanted, F.lit(False))), [*by, "_wanted"], total, *first)
    taken = some.withColumn("_taken", F.col("_wanted") & (F.col("place") <= min(least, total))).drop("_wanted", "place")
    fill = Window.partitionBy(*by).orderBy(F.desc("_taken"), *first)
    kept = taken.withColumn("_fill", F.row_number().over(fill)).where(F.col("_fill") <= total)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*final))).drop("_taken", "_fill")


def unique_labels(df: DataFrame, base: str, out: str, *order: Column) -> DataFrame:
    """The label, with __2, __3 and so on from its second row on by ``order``, which must not tie."""
    n = F.col("_nth")
    labelled = group_places(df, [base], *order, out="_nth")
    return labelled.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("__", F.col(base), n.cast("string")))).drop("_nth")


def serial(df: DataFrame, prefix: str, width: int, out: str, by: Sequence[str], *order: Column) -> DataFrame:
    """Zero-padded numbers within each group by ``order``, which must not tie, such as L0001; longer ones keep all digits."""
    n = F.col("_nth").cast("string")
    padded = F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
    return group_places(df, by, *order, out="_nth").withColumn(out, F.concat(F.lit(prefix), padded)).drop("_nth")


def winners_log(df: DataFrame, by: str, length: str, ident: str, *order: Column) -> DataFrame:
    """Each row with the best of its group up to it (longest, then larger id): who had won at that time."""
    return running_max(df, [by], F.struct(length, ident), *order, out="_best").withColumn("winner_then", F.col("_best")[ident]).drop("_best")


def global_and_group_rank(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """``overall_rank`` over all rows and ``group_rank`` within groups by ``order``, which must not tie.

    Both are places in a table sorted in ranges, so neither the whole table nor
    a large group is ranked in one task.
    """
    return group_places(places(df, *order, out="overall_rank"), by, *order, out="group_rank")
