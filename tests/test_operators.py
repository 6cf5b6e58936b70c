"""Hand-checked cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import arrays as arr
from quarrystone.functions import newick
from quarrystone.functions import numbers as nm
from quarrystone.functions import stats as st
from quarrystone.functions import tails
from quarrystone.functions import text as tx
from quarrystone.operators import annotation, audit, events, evolution, joins, occupancy, ranking, scoring, selection, trees, validation


def one(spark, **columns):
    r = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return tuple(r) if len(columns) > 1 else r[0]


def test_numbers(spark):
    assert one(spark, a=nm.whole(F.lit("3.9")), b=nm.whole(F.lit("x"), 7), c=nm.finite(F.lit("NaN"), 1.0), d=nm.finite(F.lit("inf"))) == (3, 7, 1.0, None)
    assert one(spark, a=nm.ratio(F.lit(1), F.lit(0)), b=nm.clamp(F.lit(1.5)), c=nm.neg_log10(F.lit(0.0))) == (0.0, 1.0, 50.0)


def test_text(spark):
    assert one(spark, a=tx.present(F.lit(" N/A ")), b=tx.first_present(F.lit("-"), F.lit("x"))) == ("", "x")
    assert one(spark, a=tx.terms(F.lit("b, a,-,b"))) == ["a", "b"]
    assert one(spark, a=tx.label(F.lit("..a b/c..")), b=tx.label(F.lit("///"))) == ("a_b_c", "sequence")
    assert one(spark, **dict(zip("abc", tx.node_parts(F.lit("A<12>"))))) == ("A", 12, True)
    assert one(spark, **dict(zip("abc", tx.node_parts(F.lit("<7>"))))) == ("", 7, False)
    assert one(spark, **dict(zip("ab", tx.gene_key(F.lit("x LOC12 y"), F.lit("x"))))) == ("refseq_locus:LOC12", "refseq_locus")
    assert one(spark, **dict(zip("ab", tx.gene_key(F.lit("t_g7_i2.p1 LOC12"), F.lit("t_g7_i2.p1"))))) == ("transdecoder_gene:g7", "transdecoder_gene")
    assert one(spark, **dict(zip("ab", tx.gene_key(F.lit("x"), F.lit("x"))))) == ("unique_id:x", "unique_id")
    assert one(spark, **dict(zip("abcd", tx.composite_id(F.lit("s|g|OG1"))))) == ("s", "g", "OG1", True)
    assert one(spark, a=tx.reasons((F.lit(True), "x"), (F.lit(False), "y"), (F.lit(True), "z"))) == "x;z"


@pytest.mark.parametrize("by", [[], ["g"]])
def test_benjamini_hochberg(spark, by):
    rows = spark.createDataFrame([("a", 0.01, 1), ("b", 0.04, 1), ("c", 0.03, 1), ("d", None, 1)], "k string, p double, g int")
    got = {r.k: r.q for r in st.benjamini_hochberg(rows, "p", "q", by).collect()}
    assert got["d"] is None and [round(got[k], 9) for k in "abc"] == [0.03, 0.04, 0.04]
    assert st.benjamini_hochberg(rows.limit(0), "p", "q", by).count() == 0


def test_hypergeometric(spark):
    rows = spark.createDataFrame([(20, 8, 6, 4), (20, 8, 6, 7)], "n int, k int, d int, x int")
    assert [round(r[0], 9) for r in rows.select(tails.hypergeometric_tail("n", "k", "d", "x")).collect()] == [round(5320 / 38760, 9), 0.0]
    assert one(spark, a=st.haldane_odds(F.lit(4), F.lit(6), F.lit(8), F.lit(20))) == pytest.approx(4.2)


def test_ranks_and_tests(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert sorted(r.rank for r in st.average_ranks(rows, [], "v", "rank").collect()) == [1.0, 2.5, 2.5, 4.0]
    xy = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "x int, y double")
    r = st.spearman_test(xy, "x", "y").first()
    assert r.rho == pytest.approx(1.0) and r.p_value == pytest.approx(0.0, abs=1e-6)
    f = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int").select(tails.fisher_exact("a", "b", "c", "d").alias("t")).first().t
    assert f.p_value == pytest.approx(0.4857142857) and f.odds_ratio == pytest.approx(6.408309, abs=1e-4)
    assert math.isnan(spark.createDataFrame([(1, 1), (1, 2)], "x int, y int").agg(st.pearson(F.col("x"), F.col("y"))).first()[0])
    ws = spark.createDataFrame([(1.1, 1), (2.2, 1), (3.3, 1), (4.4, 0), (5.5, 0), (6.6, 0)], "v double, g int")
    w = st.rank_sum_test(ws, "v", F.col("g") == 1).first()
    assert w.w == 0 and w.p_value == pytest.approx(0.0808556, abs=1e-6)


def test_interval_union(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 5, 8), ("a", 11, 20), ("a", 30, 40)], "k string, s int, e int")
    assert arr.interval_union(rows, ["k"], "s", "e", "n", F.lit(100)).first().n == 31


def test_sequences(spark):
    assert one(spark, a=arr.reverse_complement(F.lit("ACGTn")), b=arr.clean_cds(F.lit("auGx"))) == ("nACGT", "ATGN")
    assert one(spark, a=arr.translated(F.lit("ATGGCNTAA")), b=arr.translated(F.lit("ATGA"))) == ("MA", None)
    assert one(spark, a=arr.back_translated(F.lit("M-K"), F.lit("ATGAAA")), b=arr.back_translated(F.lit("M"), F.lit("ATGAAA"))) == ("ATG---AAA", None)
    assert one(spark, a=arr.compatible(F.lit("MKX"), F.lit("LKA")), b=arr.compatible(F.lit("MKA"), F.lit("MRA")), c=arr.compatible(F.lit("M*A"), F.lit("M*A"))) == (True, False, False)
    assert one(spark, a=arr.wrapped(F.lit("A" * 7), 3)) == "AAA\nAAA\nA"
    assert one(spark, a=arr.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_occupancy(spark):
    rows = {"u": [1, 1, 1, 1, 1], "m": [2, 1, 1, 1, 1], "n": [1, 0, 3, 1, 1], "s": [0, 0, 0, 4, 0], "h": [1, 1, 0, 0, 0]}
    species = list("abcde")
    long = spark.createDataFrame([(f, s, n) for f, ns in rows.items() for s, n in zip(species, ns) if n], "family string, species string, n int")
    stats = occupancy.row_stats(long, species)
    assert {r.family: r.category for r in stats.collect()} == {"u": "universal_single_copy", "m": "universal_multicopy", "n": "near_core", "s": "species_specific", "h": "shell"}
    assert sum(r.percent_families for r in occupancy.category_summary(stats).collect()) == 100
    assert len(occupancy.category_summary(stats.where("family = 'u'")).collect()) == 5


def test_events(spark):
    rows = spark.createDataFrame([(3, 2, 0.1), (1, -2, 0.1), (1, 0, 0.1)], "child int, change int, p double")
    assert sorted((r.direction, r.fold) for r in events.derive(rows).collect()) == [("contraction", 2.0), ("expansion", 2.0)]
    tier = lambda q, p, c: one(spark, t=events.event_tier(F.lit(q), F.lit(p), F.lit(c)))
    assert [tier(0.04, 0.01, 2), tier(0.04, 0.01, 1), tier(0.9, 0.06, 9)] == ["high", "candidate", "supporting"]


def test_labels(spark):
    got = [one(spark, a=validation.support_class(F.lit(x))) for x in ("85/96", "85/50", "65/10", "10/10", None)]
    assert got == ["strong", "partial_strong", "moderate", "low", "unknown"]
    assert one(spark, a=validation.lineage(F.lit("1,2759,33208")), b=validation.lineage(F.lit(None).cast("string"))) == ("metazoa", "unknown")
    assert [one(spark, a=scoring.relax_label(F.lit(k).cast("double"))) for k in (1.2, 0.8, 1.0, None)] == ["intensified", "relaxed", "unchanged", ""]
    assert one(spark, a=scoring.family_tier(F.lit(80.0), F.lit(6), F.lit(False), F.lit(0.4))) == "tier2_supported"
    assert one(spark, a=scoring.available_score({"tree": F.lit(5.0), "expression": F.lit(None).cast("double")}, scoring.MAXIMA)) == 50.0


def test_consensus_and_union(spark):
    rows = spark.createDataFrame([("x", v) for v in "baab"], "k string, v string")
    assert tuple(annotation.consensus(rows, ["k"], "v").first()) == ("x", "a", 2, 0.5, 2)
    a, b = (spark.createDataFrame(r, "id int, seq string") for r in ([(1, "x"), (2, "y")], [(1, "z")]))
    assert {(r.id, tuple(r.sources), r.conflicts) for r in annotation.union_distinct({"a": a, "b": b}, "id", "seq").collect()} == {(1, ("a", "b"), 1), (2, ("a",), 0)}


def test_selection(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0, 10 - i) for i in range(10)], "id int, wanted boolean, score int")
    got = ranking.quota(rows.withColumn("g", F.lit(1)), ["g"], F.col("wanted"), 2, 4, [F.desc("score"), F.col("id")], [F.desc("score"), F.col("id")])
    assert [(r.id, r.rank) for r in got.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert ranking.quota(rows.withColumn("g", F.lit(1)).where("id > 3"), ["g"], F.col("wanted"), 2, 4, [F.col("id")], [F.col("id")]).where("wanted").count() == 2


def test_joins(spark):
    nodes = spark.createDataFrame([("a<1>",), ("ab<2>",), ("c",)], "node string")
    names = spark.createDataFrame([("a",), ("ab",)], "sp string")
    assert {r.node: r.sp for r in joins.longest_prefix(nodes, "node", names, "sp").collect()} == {"a<1>": "a", "ab<2>": "ab", "c": None}
    refs = spark.createDataFrame([("g.1", 1), ("g.2", 2)], "ident string, v int")
    want = spark.createDataFrame([("g.2",), ("g.9",), ("h",)], "k string")
    assert {r.k: r.v for r in joins.versioned(want, refs, "k", "ident").collect()} == {"g.2": 2, "g.9": 1, "h": None}
    frag = spark.createDataFrame([("y", 1, 3)], "alias string, start int, end int")
    rec = spark.createDataFrame([(["x", "y"], "ACGT")], "aliases array<string>, seq string")
    assert joins.slices(frag, rec).first().part == "CG"


def test_trees(spark):
    t = newick.parse("((A:1,'B b':2)x:1,C:3);")
    assert newick.write(t) == "((A:1,B_b:2)x:1,C:3);" and t.distances()[t.name.index("C")] == 3
    for bad in ("((A,B);", "A,B;", "(A,B));"):
        with pytest.raises(ValueError):
            newick.parse(bad)
    species = trees.SpeciesTree("((A:1,B:1):1,C:1);")
    r = trees.reconcile(newick.parse("((a1,a2),b1);"), {"a1": "A", "a2": "A", "b1": "B"}, species)
    assert (r["n_dup"], r["n_spec"], r["n_loss"]) == (1, 1, 0)
    r = trees.reconcile(newick.parse("(a1,c1);"), {"a1": "A", "c1": "C"}, species)
    assert (r["n_dup"], r["n_spec"], r["n_loss"]) == (0, 1, 1) and [species.ids[s] for *_, s in r["losses"]] == ["B"]
    assert trees.pruned("((a:1,b:1)n:1,(c:1,d:1):1);", {"a", "b", "c"}, {"a": "test"}) == "((a{test}:1,b:1):1,c:2);"
    top = trees.ultrametric(trees.node_table(spark.createDataFrame([("t", "((A:1,B:2):1,C:3);")], "tree_id string, newick string")), 100.0)
    assert top.where("name = 'A'").first().branch_length == pytest.approx(2 / 3 * 100)


def test_rerooting_and_restoring():
    t = trees.rooted_like("(A:1,(B:1,(C:1,D:1):1):1);", "((A,B),(C,D));")
    assert sorted(sorted(newick.parse(t).leaf_sets()[c]) for c in newick.parse(t).down[0]) == [["A", "B"], ["C", "D"]]
    for bad in ("((A,C),(B,D));", "((A,B),(C,E));", "(A,B,(C,D));"):
        with pytest.raises(ValueError):
            trees.rooted_like("(A:1,(B:1,(C:1,D:1):1):1);", bad)
    assert trees.with_identical("(a:1,b:2);", {"a": "S", "b": "T", "c": "S"}) == "((a:0,c:0):1,b:2);"
    with pytest.raises(ValueError):
        trees.with_identical("(a:1,b:2);", {"a": "S", "b": "T", "c": "U"})


def test_selection_rules(spark):
    ok, why = selection.eligible(F.lit(3), F.lit(2), F.lit(3))
    assert one(spark, a=ok, b=why) == (False, "too_few_strict_sequences;too_few_species")
    rows = spark.createDataFrame([("x", 81.25), ("y", 70.0)], "species string, complete_pct double")
    assert {r.species: (r.analysis_role, r.reason) for r in selection.core_set(rows).collect()} == {"x": ("core", "BUSCO complete 81.3% >= 80.0%"), "y": ("supplementary", "BUSCO complete 70.0% < 80.0%")}
    with pytest.raises(ValueError):
        selection.core_set(rows, least_core=4)


def test_bar_chart():
    svg = audit.bar_chart("a < b", [("x & y", 3.0), ("z", 0.0)])
    assert svg.startswith("<svg") and "a &lt; b" in svg and "x &amp; y" in svg


def test_archive(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("x")
    assert audit.archive(str(tmp_path / "in"), str(tmp_path / "o.tar.gz")) == 1
    assert audit.versions([("python", ["python", "--version"]), ("none", ["no-such-tool"])])[1][1] == "missing"


def test_json_results(spark):
    doc = '{"test results": {"p-value": 0.02, "LRT": 4.5}, "branch attributes": {"0": {"n1": {"Corrected P-value": 0.01, "omega ratio": 2.0}, "n2": {"x": 1}}}}'
    rows = spark.createDataFrame([("f", doc), ("g", "oops"), ("h", None)], "family string, doc string")
    got = {r.family: (r.p, r.k) for r in rows.select("family", evolution.test_result(F.col("doc"), "p-value").alias("p"), evolution.find_number(F.col("doc"), "lrt").alias("k")).collect()}
    assert got == {"f": (0.02, 4.5), "g": (None, None), "h": (None, None)}
    b = {r.branch: (r.corrected_p, r.omega) for r in evolution.branch_table(rows, "doc").collect()}
    assert b == {"n1": (0.01, 2.0), "n2": (None, None)}


def test_core_rows_are_written_or_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "species string, n int")
    core = selection.core_set(spark.createDataFrame([("a", 90.0), ("b", 10.0)], "species string, complete_pct double"))
    assert selection.write_core(rows, core, str(tmp_path / "core")) == 2
    assert {r.n for r in spark.read.parquet(str(tmp_path / "core")).collect()} == {1, 2}
    with pytest.raises(Exception, match="fewer than 2 core species"):
        selection.write_core(rows, core, str(tmp_path / "none"), least_core=2)
