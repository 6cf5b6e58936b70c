"""Tails of distributions against exact numbers, and groups of any size in ranges and bounded sets."""

import math
import random
from collections import Counter
from decimal import Decimal, getcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import arrays, stats, tails
from quarrystone.operators import ranking, validation
from quarrystone.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hypergeometric_tails_by_fractions(spark):
    rng, rows = random.Random(1), [(0, 0, 0, 0), (5, 5, 5, 5), (7, 0, 3, 1), (9, 4, 0, 0)]
    for _ in range(200):
        n = rng.choice([5, 30, 400, 20_000])
        k, d = rng.randrange(0, n + 1), rng.randrange(0, min(n, 400) + 1)
        rows.append((n, k, d, max(0, min(k, d, int(k * d / n + rng.gauss(0, 3 + math.sqrt(k * d / n)))))))
    for r in spark.createDataFrame(rows, "n long, k long, d long, x long").withColumn("p", tails.hypergeometric_tail("n", "k", "d", "x")).collect():
        some = sum(math.comb(r.k, i) * math.comb(r.n - r.k, r.d - i) for i in range(r.x, min(r.k, r.d) + 1))
        assert r.p == pytest.approx(float(Fraction(some, math.comb(r.n, r.d))), rel=1e-12, abs=1e-300)


def test_normal_and_gamma(spark):
    zs = [0.0, 0.1, 1.0, -2.9, 2.999999, 3.0, 5.0, -8.0, 20.0, 37.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", tails.two_sided_normal("z")).collect()
    assert [r.p for r in got] == [pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12) for z in zs]
    xs = [1e-3, 0.5, 1.0, 2.0, 3.3, 9.99, 10.0, 1e3, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("g", tails.log_gamma("x")).collect()
    assert [r.g for r in got] == [pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13) for x in xs]
    one = spark.createDataFrame([(None, float("nan"))], "a double, b double").select(tails.two_sided_normal("a").alias("a"), tails.two_sided_normal("b").alias("b")).first()
    assert one.a is None and math.isnan(one.b)


def test_student_by_closed_form(spark):
    """Even degrees of freedom have a finite sum."""
    getcontext().prec = 60

    def exact(t, n):
        t, c = Decimal(t), Decimal(n) / (n + Decimal(t) ** 2)
        term = total = Decimal(1)
        for j in range(1, n // 2):
            term *= Decimal(2 * j - 1) / (2 * j) * c
            total += term
        return float(1 - t / (n + t * t).sqrt() * total)

    rows = [(t, float(n)) for t in (0.01, 0.5, 1.0, 2.0, 5.0, 12.0) for n in (2, 4, 10, 100, 998)]
    for r in spark.createDataFrame(rows, "t double, n double").withColumn("p", tails.two_sided_student(-F.col("t"), "n")).collect():
        assert r.p == pytest.approx(exact(r.t, int(r.n)), rel=1e-12)
    odd = spark.createDataFrame([(0.0, 3.0), (float("inf"), 3.0), (1.0, 0.0), (1.0, 1.0)], "t double, n double").withColumn("p", tails.two_sided_student("t", "n")).collect()
    assert [odd[0].p, odd[1].p] == [1.0, 0.0] and math.isnan(odd[2].p) and odd[3].p == pytest.approx(0.5, rel=1e-12)


def test_fisher_by_fractions(spark):
    tables = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (5, 0, 1, 4), (100, 30, 50, 200), (0, 0, 2, 3), (7, 7, 7, 7)]
    for r in spark.createDataFrame(tables, "a int, b int, c int, d int").withColumn("f", tails.fisher_exact("a", "b", "c", "d")).collect():
        m, n, k = r.a + r.b, r.c + r.d, r.a + r.c
        weights = {i: math.comb(m, i) * math.comb(n, k - i) for i in range(max(0, k - n), min(k, m) + 1)}
        want = Fraction(sum(w for w in weights.values() if w <= weights[r.a]), sum(weights.values()))
        assert r.f.p_value == pytest.approx(float(want), rel=1e-12)
        if max(0, k - n) < r.a < min(k, m):  # there the mean of the tilted distribution is the cell
            tilted = {i: w * r.f.odds_ratio ** (i - r.a) for i, w in weights.items()}
            assert sum(i * w for i, w in tilted.items()) / sum(tilted.values()) == pytest.approx(r.a, rel=1e-9)
        else:
            assert r.f.odds_ratio == (0.0 if r.a == max(0, k - n) else math.inf)


@pytest.mark.parametrize("name", ["enrichment_hypergeom", "wilcoxon_p_value", "spearman_statistic", "fisher", "entropy_bits"])
def test_no_python_in_the_plan(spark, name):
    plan = plan_of(catalogue.QUERIES[name](spark, SF))
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert name != "entropy_bits" or "Generate" not in plan and "Exchange" not in plan


def test_letters_by_counting(spark):
    texts = ["", "abcabca", "zzz", "é a", None, "a" * 5000]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumn("bits", validation.entropy(F.col("t"), "abcz")).collect():
        counts = [c for x in "abcz" if (c := (r.t or "").count(x))]
        want = -sum(c / sum(counts) * math.log2(c / sum(counts)) for c in counts) if counts else None
        assert r.bits == (want if want is None else pytest.approx(want, abs=1e-12))


@pytest.fixture
def hot(spark):
    """Eight partitions, not joined up again: a group of 95 % of the rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(5)
    rows = [("hot" if i % 20 else f"g{i % 60}", s := rng.randrange(50_000), s + rng.randrange(-2, 30), i) for i in range(12_000)]
    yield rows
    for k, v in before.items():
        spark.conf.set(k, v)


def test_intervals_of_a_hot_group(spark, hot):
    table = spark.createDataFrame(hot, "g string, s int, e int, i int").repartition(5)
    covered = {}
    for g, s, e, _ in hot:
        covered.setdefault(g, set()).update(range(max(s, 1), min(e, 40_000) + 1))
    got = {r.g: r.n for r in arrays.interval_union(table, ["g"], "s", "e", "n", F.lit(40_000)).collect()}
    assert got == {g: len(p) for g, p in covered.items() if p}
    # No range, and so no task, has more than its share of the hot group.
    sizes = [r["count"] for r in stats._dealt(table, "g", "s", "e").groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(hot) / 8


def test_quota_of_a_hot_group(spark, hot):
    rng = random.Random(9)
    rows = [(g, i % 7 == 0, rng.randrange(100), i) for g, _, _, i in hot]
    table = spark.createDataFrame(rows, "g string, wanted boolean, score int, i int").repartition(5)
    got = ranking.quota(table, ["g"], F.col("wanted"), 4, 10, [F.desc("score"), F.col("i")], [F.col("i")])
    want = set()
    for g in {r[0] for r in rows}:
        some = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[3]))
        taken = [r for r in some if r[1]][:4]
        chosen = (taken + [r for r in some if r not in taken])[:10]
        want |= {(*r, k) for k, r in enumerate(sorted(chosen, key=lambda r: r[3]), 1)}
    assert {(r.g, r.wanted, r.score, r.i, r["rank"]) for r in got.collect()} == want
    # The rows of the hot group that come to the last step are a bounded number, and Spark drops the rest before it shuffles.
    some = ranking.top_per(table, ["g"], 10, F.desc("score"), F.col("i"))
    assert plan_of(some).count("WindowGroupLimit") >= 3 and some.where("g = 'hot'").count() == 10


def test_numbers_and_winners_of_a_hot_group(spark, hot):
    table = spark.createDataFrame(hot, "g string, s int, e int, i int").repartition(5)
    seen, best, want = Counter(), {}, {}
    for g, s, e, i in hot:
        seen[g] += 1
        best[g] = max(best.get(g, (-1, -1)), (e, i))
        want[i] = (g if seen[g] == 1 else f"{g}__{seen[g]}", f"L{seen[g]:03d}", best[g][1])
    done = ranking.winners_log(ranking.serial(ranking.unique_labels(table, "g", "label", F.col("i")), "L", 3, "serial", ["g"], F.col("i")), "g", "e", "i", F.col("i"))
    assert {r.i: (r.label, r.serial, r.winner_then) for r in done.collect()} == want
