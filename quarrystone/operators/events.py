"""Copy-number change events: direction, tiers, scores, family ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.numbers import neg_log10

FDR, HIGH_P, CANDIDATE_P, HIGH_CHANGE = 0.05, 0.01, 0.05, 2  # fixed values: thresholds
EVENT_ORDER = {"high": 0, "candidate": 1, "supporting": 2}
FAMILY_ORDER = {"high": 0, "fdr_supported": 1, "candidate": 2, "family_only": 3}


def derive(rows: DataFrame, child: str = "child", change: str = "change", p: str = "p") -> DataFrame:
    """Rows with a change and a finite p: parent, direction and fold with one count added to both sides."""
    good = (F.col(change) != 0) & F.col(p).isNotNull() & ~F.isnan(p)
    parent = (F.col(child) - F.col(change)).cast("bigint")
    up = F.col(change) > 0
    grown = (F.col(child) + 1) / (F.col("parent") + 1)
    return rows.where(good).withColumn("parent", parent).withColumns(
        {"direction": F.when(up, "expansion").otherwise("contraction"), "fold": F.when(up, grown).otherwise(F.try_divide(F.lit(1.0), grown))}
    )


def event_tier(q: Column, p: Column, change: Column) -> Column:
    return F.when((q <= FDR) & (p <= HIGH_P) & (F.abs(change) >= HIGH_CHANGE), "high").when(p <= CANDIDATE_P, "candidate").otherwise("supporting")


def event_score(q: Column, p: Column, change: Column, fold: Column, terminal: Column) -> Column:
    """Evidence, rounded to six places: ranks are taken from what is shown."""
    value = neg_log10(q) + neg_log10(p) + F.log2(1 + F.abs(change)) + F.log2(F.greatest(F.lit(1.0), fold)) + terminal.cast("int")
    return F.round(value, 6)


def order_of(tier: Column, order: dict[str, int]) -> Column:
    out = F.lit(len(order))
    for name, place in order.items():
        out = F.when(tier == name, place).otherwise(out)
    return out


def family_tier(high: Column, candidate: Column, q: Column) -> Column:
    return F.when(high > 0, "high").when(q <= FDR, "fdr_supported").when(candidate > 0, "candidate").otherwise("family_only")


def with_all(found: DataFrame, every: DataFrame, family: str = "family") -> DataFrame:
    """``families`` of every row of ``every`` (family, q): those without an event have zero counts, no best event and a tier by q alone."""
    counts = ["high_events", "candidate_events", "terminal_expansions", "terminal_contractions"]
    rows = every.select(family, F.round("q", 9).alias("q")).join(found.drop("q", "tier"), family, "left").na.fill(0, counts)
    return rows.withColumn("tier", family_tier(F.col("high_events"), F.col("candidate_events"), F.col("q")))


def families(events: DataFrame, family: str = "family") -> DataFrame:
    """Events (tier, direction, terminal, score, node, change, p, q) by family:
    counts, the best event (highest score, then first node) and the tier."""
    best = F.max_by(F.struct("node", "direction", "change", "p", "score"), F.struct(F.col("score"), -F.col("node"))).alias("_best")
    terminal = F.col("terminal")
    got = events.groupBy(family).agg(
        F.min("q").alias("q"),
        F.count_if(F.col("tier") == "high").alias("high_events"),
        F.count_if(F.col("tier") == "candidate").alias("candidate_events"),
        F.count_if(terminal & (F.col("direction") == "expansion")).alias("terminal_expansions"),
        F.count_if(terminal & (F.col("direction") == "contraction")).alias("terminal_contractions"),
        best,
    )
    return got.withColumn("tier", family_tier(F.col("high_events"), F.col("candidate_events"), F.col("q"))).select(
        family, "tier", F.round("q", 9).alias("q"), "high_events", "candidate_events", "terminal_expansions", "terminal_contractions",
        F.col("_best.node").alias("best_node"), F.col("_best.direction").alias("best_direction"), F.col("_best.change").cast("bigint").alias("best_change"), F.col("_best.score").alias("score"),
    )
