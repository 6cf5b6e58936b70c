"""Small cases whose results are worked out by hand."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import newick, stats, tails
from quarrystone.operators import joins, quality, ranking, rooting, scoring, sensitivity, sinks, trees
from quarrystone.sources import sequences


def test_expression_needs_a_tenth(spark):
    rows = spark.createDataFrame([(0.05,), (0.1,), (1.0,), (10.0,), (0.0,)], "tpm double")
    got = [r[0] for r in rows.select(scoring.expression_component(F.lit(True), F.lit(1), F.lit(2), F.col("tpm"))).collect()]
    assert got == [1.5, 2.5, 3.0, 3.5, 1.5]


def test_root_ties_go_to_the_smaller_side():
    species = trees.SpeciesTree("((A:1,B:1):1,(C:1,D:1):1);")
    got = trees.best_rooting("(a:1,b:1,c:1);", {"a": "A", "b": "A", "c": "A"}, species)
    assert got["signature"] == "a||b|c" and got["optimal"] == 3 and (got["n_dup"], got["n_loss"]) == (2, 0)
    # A side of one leaf comes before one of two, whatever the names.
    assert rooting.signature([["b", "a"], ["z"]]) == "z||a|b"


def test_text_before_the_first_record_fails(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="before the first record"):
        sequences.fasta(spark, str(tmp_path / "bad.fa")).collect()
    (tmp_path / "good.fa").write_text("\n>a one\nAC\nGT\n>b\n")
    assert [(r.id, r.seq) for r in sequences.fasta(spark, str(tmp_path / "good.fa")).orderBy("id").collect()] == [("a", "ACGT"), ("b", "")]


def test_ratios_stay_within_their_range(spark):
    names = {n: 2.0 if n == "change" else -1.0 for n in scoring.MAXIMA}
    other = {"base": 50.0, "critical": False, "acceptable": 1.0, "passed": 1.0, "pfam": 1.0, "high_risk": 0.0, "excluded": 0.0, "flags": 0, "domains": 7, "annotation_share": 0.0, "quality": 1.0}
    row = spark.createDataFrame([tuple((names | other).values())], list(names | other))
    score, _ = sensitivity.scenarios()["no_rna"]
    assert row.select(score).first()[0] == pytest.approx(100 * 25 / 95)


def q_values(ps, groups=None):
    """By the definition: over the sorted values of a group."""
    out = {}
    for g in set(groups or [None] * len(ps)):
        some = sorted((p, i) for i, p in enumerate(ps) if (groups[i] if groups else None) == g and p is not None and math.isfinite(p))
        low = 1.0
        for place in range(len(some), 0, -1):
            p, i = some[place - 1]
            low = min(low, p * len(some) / place)
            out[i] = low
    return [out.get(i) for i in range(len(ps))]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_false_discovery_rates(spark, by):
    """Ties in plenty, nulls, values that are no number, a null group."""
    ps = [1.0] * 980 + [0.001 * i for i in range(1, 21)] + [None, float("nan"), float("inf")]
    groups = [None if i % 3 == 0 else str(i % 3) for i in range(len(ps))]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(zip(ps, groups))], "i int, p double, g string").repartition(4)
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, "p", "q", by).collect()}
    want = q_values(ps, groups if by else None)
    assert len(got) == len(ps)
    for i, q in enumerate(want):
        assert got[i] is None if q is None else got[i] == pytest.approx(q, rel=1e-12)


def test_ties_make_no_large_task(spark):
    """Of 50,000 values 98 % are equal: what is dealt out holds one row for them."""
    df = spark.range(50_000).select(F.when(F.col("id") % 50 == 0, F.col("id") / 1e6).otherwise(1.0).alias("p"))
    counts = df.groupBy("p").agg(F.count("*").alias("_n"))
    dealt = stats._dealt(counts, "p")
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert sum(sizes) == counts.count() == 1001 and max(sizes) <= 2 * 1001 / len(sizes) + 10
    # A table whose sort value is one and the same is dealt out by what breaks the tie.
    placed = stats.places(spark.range(40_000).select(F.lit(1).alias("v"), "id"), F.desc("v"), "id")
    assert placed.where("place <> id + 1").count() == 0


def test_ranks_of_groups(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, (i * 7) % 11) for i in range(50)], "i int, g string, v int")
    got = {r.i: (r.overall_rank, r.group_rank) for r in ranking.global_and_group_rank(df, ["g"], F.desc("v"), F.col("i")).collect()}
    order = sorted(range(50), key=lambda i: (-((i * 7) % 11), i))
    for i in range(50):
        same = [j for j in order if bool(j % 3) == bool(i % 3)]
        assert got[i] == (order.index(i) + 1, same.index(i) + 1)


def test_rank_tests_beside_definitions(spark):
    values = [3, 1, 1, 2, 5, 5, 5, 8, 0, 2]
    first = [1, 0, 1, 0, 1, 1, 0, 0, 1, 0]
    rank = [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]
    df = spark.createDataFrame([(v, f, i) for i, (v, f) in enumerate(zip(values, first))], "v int, f int, i int")
    got = stats.rank_sum_test(df, "v", F.col("f") == 1).first()
    n = sum(first)
    assert got.w == sum(r for r, f in zip(rank, first) if f) - n * (n + 1) / 2
    rho = stats.spearman_test(df, "v", "i").first().rho
    mean = sum(rank) / 10
    places = [i + 1 for i in range(10)]
    cov = sum((r - mean) * (p - 5.5) for r, p in zip(rank, places))
    assert rho == pytest.approx(cov / math.sqrt(sum((r - mean) ** 2 for r in rank) * sum((p - 5.5) ** 2 for p in places)))


def test_hypergeometric_tail_exactly(spark):
    cases = [(50, 10, 12, 4), (50, 10, 12, 0), (20, 20, 5, 5), (30, 3, 4, 4), (1000, 40, 100, 12), (10, 0, 3, 0)]
    df = spark.createDataFrame(cases, "n long, k long, d long, x long").withColumn("p", tails.hypergeometric_tail("n", "k", "d", "x"))
    for r in df.collect():
        want = sum(Fraction(math.comb(r.k, i) * math.comb(r.n - r.k, r.d - i), math.comb(r.n, r.d)) for i in range(r.x, min(r.k, r.d) + 1))
        assert r.p == pytest.approx(float(want), rel=1e-9, abs=1e-300)


def test_cycles_are_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        trees.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "node string, parent string"))


def test_deep_trees_are_pruned():
    text = "x0:1"
    for i in range(1, 3000):
        text = f"({text},x{i}:1):1"
    assert trees.pruned(f"{text};", {"x0", "x2999"}, {"x0": "test"}) == "(x0{test}:2999,x2999:1);"
    assert trees.can_relax("((a{test}:1,b{test}:1):1,c{reference}:1,d{reference}:1);") and not trees.can_relax("(a{test}:1,c{reference}:1,d:1);")


def test_uneven_trees(spark):
    rows = spark.createDataFrame([("even", "(A:2,(B:1,C:1):1);"), ("odd", "(A:2,(B:1,C:3):1);"), ("negative", "(A:2,(B:-1,C:-1):3);")], "tree_id string, newick string")
    assert {r.tree_id: r.uneven for r in trees.uneven(trees.node_table(rows)).collect()} == {"even": False, "odd": True, "negative": True}


def test_renaming_fails_without_a_name(spark):
    rows, names = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", "x")], "k string, n string")
    with pytest.raises(Exception, match="no name for b"):
        joins.renamed(rows, names, "k", "n").collect()


def test_residues(spark):
    rows = spark.createDataFrame([("ACX*",), ("A*C",), ("",), ("a1#C1",)], "s string").select(
        quality.unknown_share(F.col("s")).alias("u"), quality.inner_stop(F.col("s")).alias("i"), quality.end_stop(F.col("s")).alias("e"), quality.invalid_residues(F.col("s")).alias("b")
    )
    assert [tuple(r) for r in rows.collect()] == [(0.25, False, True, []), (0.0, True, False, []), (1.0, False, False, []), (0.0, False, False, ["#", "1", "a"])]


def test_commits_and_sync(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    folder = str(tmp_path / "runs")
    sinks.commit(df, folder, "1")
    df.write.parquet(f"{folder}/run_2")  # written, never committed
    assert sinks.latest(spark, folder).count() == 2 and "k" in sinks.latest(spark, folder).columns
    with pytest.raises(Exception):
        sinks.commit(df, folder, "1")
    target = str(tmp_path / "archive")
    df.where("k = 1").write.parquet(target)
    assert sinks.sync(df, target, "k") == 1 and sinks.sync(df, target, "k") == 0 and spark.read.parquet(target).count() == 2
