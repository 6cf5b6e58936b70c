"""Missing-aware evidence scores of families and genes, tiers and ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.numbers import clamp, ratio, rounded

# The most that each component can give, points of a status, least score, domains and acceptable share of each tier.
# Those inside the component functions (points, thresholds) are fixed as well.
MAXIMA = {"change": 25.0, "annotation": 10.0, "sequence": 20.0, "tree": 10.0, "reconciliation": 10.0, "evolution": 20.0, "expression": 5.0}
STATUS_POINTS = {"pass": 20.0, "review": 14.0, "review_high": 6.0, "exclude_recommended": 0.0}
TIERS = ((75, 6, 0.50, "tier1_high_confidence"), (60, 5, 0.35, "tier2_supported"), (45, 4, None, "tier3_provisional"))


def change_component(rank: Column, k: int = 30) -> Column:
    return 25 * F.greatest(F.lit(1.0 / k), (k + 1 - F.coalesce(rank, F.lit(k))) / float(k))


def annotation_component(share: Column, *found: tuple[Column, int]) -> Column:
    return 4 * clamp(share) + sum((F.when(c, points).otherwise(0) for c, points in found), F.lit(0.0))


def sequence_component(passed: Column, reviewed: Column, size: Column, pfam: Column, high_risk: Column) -> Column:
    ok = F.least(F.lit(1.0), ratio(passed + reviewed, size))
    return 8 * ok + 4 * ratio(passed, size) + 3 * clamp(pfam) + 5 * (1 - clamp(high_risk))


def tree_component(complete: Column, mode: Column) -> Column:
    best = F.when(mode == "ufboot1000_alrt1000", 4).when(F.coalesce(mode, F.lit("")) != "", 2).otherwise(0)
    return F.when(complete, 6).otherwise(0) + best


def reconciliation_component(present: Column, reconciled: Column, given: Column, supported: Column) -> Column:
    return F.when(present, 4 + 3 * F.least(F.lit(1.0), ratio(reconciled, given)) + F.when(supported, 3).otherwise(0)).otherwise(0.0)


def evolution_component(available: Column, busted: Column, branches: Column, relax: Column) -> Column:
    """Null where the tests did not run: missing evidence is not zero."""
    q = lambda c: F.coalesce(c <= 0.05, F.lit(False))
    return F.when(available, F.when(q(busted), 8).otherwise(0) + F.when(branches > 0, 6).otherwise(0) + F.when(q(relax), 6).otherwise(0).cast("double"))


def expression_component(available: Column, detected: Column, copies: Column, most: Column) -> Column:
    top = F.when(most >= 10, 2.0).when(most >= 1, 1.5).when(most >= 0.1, 1.0).otherwise(0.0)
    return F.when(available, 3 * clamp(ratio(detected, copies)) + top)


def risk_gate(excluded: Column, flagged: Column, size: Column) -> Column:
    return (ratio(excluded, size) > 0.25) | (ratio(flagged, size) > 0.50)


def available_score(components: Mapping[str, Column], maxima: Mapping[str, float]) -> Column:
    """100 times what the components give by the most that those not null can give."""
    got = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in components.values()])
    most = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), float(maxima[n])).otherwise(0.0) for n, c in components.items()])
    return ratio(100 * got, most)


def domain_count(annotation: Column, *optional: Column) -> Column:
    """Four domains that are always there, one for annotation above 0, one for each optional component there is."""
    return reduce(lambda a, b: a + b, [F.lit(4), F.when(annotation > 0, 1).otherwise(0), *[F.when(c.isNotNull(), 1).otherwise(0) for c in optional]])


def family_tier(score: Column, domains: Column, risk: Column, ok: Column) -> Column:
    out = F.when(risk, "manual_review_required")
    for least, breadth, share, name in TIERS:
        good = (score >= least) & (domains >= breadth)
        out = out.when(good if share is None else good & (ok >= share), name)
    return out.otherwise("lower_priority")


def status_points(status: Column) -> Column:
    out = F.lit(5.0)
    for name, points in STATUS_POINTS.items():
        out = F.when(status == name, points).otherwise(out)
    return out


def expression_points(tpm: Column) -> Column:
    return F.when(tpm >= 10, 10.0).when(tpm >= 1, 8.0).when(tpm >= 0.1, 5.0).when(tpm > 0, 2.0).otherwise(0.0)


def gene_score(family_score: Column, status: Column, tpm: Column) -> Column:
    """0.7 of the family's score (as shown, three places), points of the status, and of expression where measured."""
    available = tpm.isNotNull()
    raw = 0.70 * rounded(family_score, 3) + status_points(status) + F.when(available, expression_points(tpm)).otherwise(0.0)
    return 100 * raw / (90 + F.when(available, 10).otherwise(0))


def gene_tier(score: Column, status: Column, critical: Column) -> Column:
    return (
        F.when((status == "exclude_recommended") | critical, "manual_review_or_exclude")
        .when((score >= 75) & (status == "pass"), "tier1_high_confidence")
        .when((score >= 60) & status.isin("pass", "review"), "tier2_supported")
        .when(score >= 45, "tier3_provisional")
        .otherwise("lower_priority")
    )


def relax_label(k: Column) -> Column:
    return F.when(k > 1, "intensified").when(k < 1, "relaxed").when(k == 1, "unchanged").otherwise("")


def group_summary(scored: DataFrame) -> DataFrame:
    """A row per group of scored families (grp, base, base_tier, critical, evolution, expression)."""
    tier = lambda n: F.count_if(F.col("base_tier").startswith(f"tier{n}_")).alias(f"tier{n}")
    return scored.groupBy("grp").agg(
        F.count("*").alias("families"), F.avg("base").alias("mean_score"), F.max("base").alias("best_score"), *map(tier, (1, 2, 3)), F.count_if("critical").alias("critical"),
        F.count("evolution").alias("with_evolution"), F.count("expression").alias("with_expression"),
    )


def star(base: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins of keyed side tables; sizes decide between broadcast and shuffle."""
    for side, keys in sides:
        base = base.join(side, list(keys), "left")
    return base
