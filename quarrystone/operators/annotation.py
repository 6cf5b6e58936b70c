"""Annotation terms: consensus, unions, coverage and over-representation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.functions.numbers import ratio
from quarrystone.functions.stats import benjamini_hochberg, fold_enrichment, haldane_odds
from quarrystone.functions.tails import hypergeometric_tail
from quarrystone.functions.text import any_present, present


def status(functional: Sequence[Column], seed: Column) -> Column:
    return F.when(any_present(*functional), "functional_annotation").when(present(seed) != "", "seed_ortholog_only").otherwise("unannotated")


def consensus(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value that is not missing, the smallest of tied ones, with its support, share and the number of values."""
    counts = df.where(present(F.col(value)) != "").groupBy(*by, present(F.col(value)).alias("consensus")).agg(F.count("*").alias("support"))
    best = F.min(F.struct((-F.col("support")).alias("less"), "consensus")).alias("_best")
    got = counts.groupBy(*by).agg(best, F.sum("support").alias("_all"), F.count("*").alias("kinds"))
    support = -F.col("_best.less")
    return got.select(*by, F.col("_best.consensus").alias("consensus"), support.alias("support"), ratio(support, F.col("_all")).alias("share"), "kinds")


def term_union(df: DataFrame, by: Sequence[str], term: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(term)).alias("terms"))


def term_counts(df: DataFrame, term: str, distinct: Mapping[str, str]) -> DataFrame:
    return df.groupBy(term).agg(*[F.countDistinct(c).alias(name) for name, c in distinct.items()])


def coverage(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, n, total, share): one pass over the table for all metrics."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(m) for m, c in metrics.items()])
    return counts.unpivot("total", list(metrics), "metric", "n").select("metric", "n", "total", ratio(F.col("n"), F.col("total")).alias("share"))


def family_coverage(df: DataFrame, by: str, annotated: Column) -> DataFrame:
    """(by, n, annotated, share) of each family."""
    got = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(annotated).alias("annotated"))
    return got.withColumn("share", ratio(F.col("annotated"), F.col("n")))


def comparison_sets(df: DataFrame, by: Sequence[str], item: str, least: int = 5) -> DataFrame:
    """Items of each comparison that has at least ``least`` of them."""
    rows = df.select(*by, item).distinct()
    big = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return rows.join(big, list(by), "left_semi")


def contingency(annotated: DataFrame, targets: DataFrame, least_hits: int = 3, least_marked: int = 5, least_drawn: int = 5) -> DataFrame:
    """Counts of each (comparison, term): population, marked, drawn and hits,
    from (item, term) and (comparison, item); only pairs with enough of each.

    Only items with a term count as population or drawn. Counts come from
    distinct rows by joins, never from sets in memory.
    """
    pairs = written(annotated.select("item", "term").distinct(), "pairs")  # read for each of the counts
    items = pairs.select("item").distinct()
    population = items.agg(F.count("*").alias("population"))
    chosen = targets.select("comparison", "item").distinct().join(items, "item", "left_semi")
    drawn = chosen.groupBy("comparison").agg(F.count("*").alias("drawn")).where(F.col("drawn") >= least_drawn)
    marked = pairs.groupBy("term").agg(F.count("*").alias("marked")).where(F.col("marked") >= least_marked)
    hits = pairs.join(chosen, "item").groupBy("comparison", "term").agg(F.count("*").alias("hits")).where(F.col("hits") >= least_hits)
    n = population.first()[0]  # one number
    cells = hits.join(drawn, "comparison").join(marked, "term").where(F.col("drawn") < n)
    return cells.select("comparison", "term", F.lit(n).alias("population"), "marked", "drawn", "hits")


def enrichment(cells: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Tail probability, false discovery rate within ``scope``, fold and odds ratio of each cell."""
    k = [F.col(c) for c in ("population", "marked", "drawn", "hits")]
    tested = written(cells.withColumn("p_value", hypergeometric_tail(*k)), "tested")  # the adjustment reads it twice
    hits, drawn, marked, population = (F.col(c) for c in ("hits", "drawn", "marked", "population"))
    return benjamini_hochberg(tested, "p_value", "q_bh", scope).withColumns(
        {"fold": fold_enrichment(hits, drawn, marked, population), "odds_ratio": haldane_odds(hits, drawn, marked, population), "significant": F.col("q_bh") <= 0.05}
    )


def core_terms(df: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """(family, core): terms that at least max(2, ceil(share n)) of a family's n items have, where n >= ``least``; from (family, item, term)."""
    n = df.groupBy("family").agg(F.countDistinct("item").alias("n")).where(F.col("n") >= least)
    k = df.select("family", "item", "term").distinct().groupBy("family", "term").agg(F.count("*").alias("k"))
    return k.join(n, "family").where(F.col("k") >= F.greatest(F.lit(2), F.ceil(share * F.col("n")))).groupBy("family").agg(F.array_sort(F.collect_list("term")).alias("core"))


def union_distinct(sources: Mapping[str, DataFrame], ident: str, body: str) -> DataFrame:
    """(ident, body, sources, conflicts): each id once with the sources that have it; conflicts counts further bodies."""
    rows = None
    for name, df in sources.items():
        part = df.select(F.col(ident), F.col(body), F.lit(name).alias("_source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(ident).agg(F.min(body).alias(body), F.array_sort(F.collect_set("_source")).alias("sources"), (F.countDistinct(body) - 1).alias("conflicts"))
