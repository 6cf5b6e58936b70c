"""Small cases of what a review found: each failed before its finding was settled."""

import hashlib
import random
import threading
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import tails
from quarrystone.functions.arrays import letter_counts
from quarrystone.functions.numbers import rounded
from quarrystone.operators import ancestors, contents, quality, sensitivity, trees, validation
from quarrystone.plans import catalogue, q_reports, q_values
from quarrystone.plans.q_sequences import LETTERS


def test_rounding_of_scores_is_that_of_sql(spark):
    """F2, F4, F8: a next digit of 5 goes the way of the product, as in SQL, and not of the shortest text of the number."""
    values = [x / 10000 for x in range(400005, 1000000, 10)]
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in values], "x double").select("x", rounded(F.col("x"), 3).alias("y")).collect()}
    want = dict(duckdb.execute("SELECT x, round(x, 3) FROM (SELECT (400005 + 10 * i) / 10000.0::DOUBLE AS x FROM range(60000) r(i))").fetchall())
    assert {x: got[x] for x in values} == {x: want[x] for x in values}


def test_two_bits_are_not_below_two(spark):
    """four letters as often as each other have 2 bits, whatever the last bit of the logarithms."""
    rows = spark.createDataFrame([(n, "".join(x * n for x in "EDAT")) for n in range(13, 200)], "n int, seq string")
    rows = rows.select("n", *[c.alias(name) for name, c in quality.marks(F.col("seq")).items()], validation.entropy(F.col("seq"), LETTERS.upper()).alias("bits"))
    none = {"duplicate": F.lit(None).cast("string"), "lineage": F.lit("metazoa"), "risks": F.array().cast("array<string>"), "family_size": F.lit(1), "length_ratio": F.lit(1.0)}
    checked = quality.validated(rows.withColumns(none | {c: F.lit(0) for c in ("n_with_domains", "domain_rich", "n_hits", "n_core", "core_jaccard")}))
    assert [r.n for r in checked.where(F.array_contains("flags", "low_sequence_complexity")).collect()] == []


def test_checked_sequences_travel_without_their_letters(spark):
    """what is joined and ranked holds no texts, so a task of a large family reads little."""
    assert not {"seq", "text"} & set(q_reports._checked(spark, "/root/testdata/sf0.001").columns)


def test_texts_end_where_marks_are_written(spark):
    """the plan of what is joined and ranked reads no text, not even to drop it later."""
    plan = q_reports._checked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "text#" not in plan


def test_lists_of_families_are_whole(spark):
    """however many families lie below a threshold, all are listed, in order."""
    rows = spark.range(3000).select(F.lit("g").alias("grp"), F.col("id").alias("family"), F.lit(True).alias("matched"), F.lit(1.0).alias("value"), F.lit(1).alias("base_rank"))
    assert [r.below_families for r in sensitivity.threshold_report(rows, (40,)).collect()] == [",".join(map(str, range(3000)))]


def test_comparison_joins_nothing(spark):
    """ranks without ties are correlated as they are; one aggregation, no join."""
    rows = spark.range(4).select(
        F.lit("s").alias("scenario"), F.lit("g").alias("grp"), (F.col("id") + 1).alias("base_rank"), F.when(F.col("id") < 2, 2 - F.col("id")).otherwise(F.col("id") + 1).alias("rank"),
        F.lit(True).alias("eligible"), F.lit("t").alias("base_tier"), F.lit("t").alias("tier"), F.lit(1).alias("shift"),
    )
    got = sensitivity.comparison(rows)
    assert [r.rho for r in got.collect()] == [0.8]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_jumps_that_reached_the_root_rest(spark, monkeypatch):
    """a level writes the nodes that are so deep, not all; only nodes climb, and none to its own root."""
    rows = []
    kept = ancestors.written
    monkeypatch.setattr(ancestors, "written", lambda df, name="table": (rows.append((name, (out := kept(df, name)).count())), out)[1])
    tree = ancestors.lifting(spark.range(1, 64).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent")))
    assert sum(n for _, n in rows) < 400  # 63 nodes in 6 rounds and more
    rows.clear()
    got = ancestors.ancestor_distance(spark.createDataFrame([(60, 0), (60, 7), (7, 60), (5, 5)], "node long, ancestor long"), tree)
    assert {(r.node, r.ancestor): r.steps for r in got.collect()} == {(60, 0): 60, (60, 7): 53, (7, 60): None, (5, 5): 0}
    assert [n for name, n in rows if name == "climbing"] == [1]


def test_json_rows_are_spread(spark):
    """few bytes with much work a row do not stay in the few tasks that read them."""
    for query in (q_values.test_results, q_values.branch_attributes):
        assert "RoundRobinPartitioning" in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_workers_hold_few_trees(spark):
    """F16: a batch of any length is parsed in slices, without pandas."""
    batch = pa.RecordBatch.from_pydict({"newick": ["(a:1,b:1);"] * 450})
    assert [part.num_rows for part in trees._slices(iter([batch]))] == [200, 200, 50]
    nodes = trees.node_table(spark.createDataFrame([(str(i), "(a:1,b:1);") for i in range(450)], "tree_id string, newick string"))
    assert "Pandas" not in nodes._jdf.queryExecution().executedPlan().toString() and nodes.count() == 1350


def test_heights_stay_off_the_driver(spark):
    """tables of trees are joined by shuffles, however small their files look."""
    nodes = trees.node_table(spark.createDataFrame([("t", "((a:1,b:1):1,c:2);")], "tree_id string, newick string"))
    for df in (trees.ultrametric(nodes), trees.uneven(nodes)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_ancestors_are_joined_by_shuffles(spark):
    """no task holds a table of nodes, however small its files look."""
    tree = ancestors.lifting(spark.range(1, 9).select(F.col("id").alias("node"), (F.col("id") % 2 - 1).alias("parent")))
    met = ancestors.common_ancestor(spark.createDataFrame([(1, 3)], "a long, b long"), tree)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["sha256", "md5"])
def test_digests_go_on_from_task_to_task(spark, tmp_path, monkeypatch, kind):
    """a large file is digested in legs by tasks that read ranges of it, and no row holds it."""
    noise, mark = random.Random(7).randbytes(250_000), b"\xef\xbb\xbf"
    files = {
        "a.bin": noise, "b.bin": noise + b"\n", "c.bin": b"\n" * 130_000, "d.bin": mark + noise, "e.bin": mark + noise + b"\n\n", "f.bin": b"x" * 500_000, "sub/a.bin": noise[::-1],
        "g.bin": b"\r\n\r" * 60_000, "h.gz": noise, "mark": mark * 2, "i %20\u00e9.bin": noise[5:], "small": b"abc", "sub/one": b"\n",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    read = []
    handed_on = contents._handed_on
    monkeypatch.setattr(contents, "_handed_on", lambda spark, path, listed, *rest: read.extend(r.size for r in listed.collect()) or handed_on(spark, path, listed, *rest))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        got = {r.path[len(f"file:{tmp_path}/") :]: r[1:] for r in contents.digested(spark, str(tmp_path), kind, large=6, leg=120_000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(read) == sorted(len(c) for n, c in files.items() if len(c) >= 6 and n != "h.gz")
    assert got == {n: (len(c), hashlib.new(kind, c).hexdigest()) for n, c in files.items()}


def test_letters_are_judged_without_a_look_up_each(spark):
    """residues by runs and counts by bytes left; as before on odd texts, letters of several bytes among them."""
    odd = [None, "", "*", "A*A", "A#\n#\u0085", "XBZJ", "xbzj", "[]^-\\", "A\U0001f600B\U0001f600", "é" * 3 + "e", "AX" * 50 + "*"]
    c = F.col("seq")
    rows = spark.createDataFrame([(x,) for x in odd], "seq string")
    got = rows.select(c, quality.invalid_residues(c).alias("rest"), quality.unknown_share(c).alias("share"), letter_counts(c, "AX").alias("ascii"), letter_counts(c, "é\U0001f600A").alias("wide"))
    assert "translate(" not in got._jdf.queryExecution().optimizedPlan().toString() and "octet_length(" in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.where("seq is not null").collect():
        share = sum(x in quality.UNKNOWN for x in r.seq) / len(r.seq) if r.seq else 1.0
        assert (r.rest, r.share) == (sorted(set(r.seq) - set(quality.RESIDUES)), share), r.seq
        assert (r.ascii, r.wide) == ([r.seq.count(x) for x in "AX"], [r.seq.count(x) for x in "é\U0001f600A"]), r.seq
    assert [(r.rest, r.share) for r in got.where("seq is null").collect()] == [(None, 1.0)]


def by_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL on ``tables`` of (rows, schema), NaN as text, which equals itself."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    seen = lambda rows: sorted(tuple("nan" if v != v else v for v in r) for r in rows)
    return seen(catalogue.QUERIES[name](spark, str(folder)).collect()), seen(con.execute(catalogue.ORACLE_SQL[name]).fetchall())


def test_empty_texts_and_halves_of_ratios(spark, tmp_path):
    """r04 F1: an empty text, and a family of them, divide by 0 as in SQL; ratios whose next digit is a 5 are rounded as there."""
    texts = [("a", "", 6), ("a", "#" * 40, 1), ("b", "", 1), ("b", "#b", 1), ("b", "y" * 500, 6), ("c", "", 1), ("d", "", 3), ("d", "d" * 50, 1), *[("e", "z" * n, 1) for n in range(1, 1280)]]
    rows = [(t, s) for s, t, times in texts for _ in range(times)]
    got, want = by_sql(spark, tmp_path, "qc_flags_severity", documents=([(i, t, len(t), s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, n_chars long, source string"))
    assert got == want and {"nan", float("inf")} < {r[1] for r in got}


def test_fisher_of_large_tables(spark):
    """r04 F6: time does not grow with the square of the first cell's range (here 108,811 places); F3: p and ratio are the exact ones, also where SQL's halving overflows."""
    tables = [(94380, 14430, 715260, 118560), (324, 66, 2718, 468), (1, 1, 1, 10**9), (10**9, 0, 2, 5)]
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    got = spark.createDataFrame(tables, "a long, b long, c long, d long").coalesce(1).withColumn("f", tails.fisher_exact("a", "b", "c", "d")).select("a", "b", "c", "d", "f.*").collect()
    late.cancel()
    for a, b, c, d, p, odds in got[:2]:
        m, n, k = a + b, c + d, a + c
        low, high = max(0, k - n), min(k, m)
        weights = {a: Decimal(1)}
        for i in range(a, high):
            weights[i + 1] = weights[i] * ((m - i) * (k - i)) / ((i + 1) * (n - k + i + 1))
        for i in range(a, low, -1):
            weights[i - 1] = weights[i] * (i * (n - k + i)) / ((m - i + 1) * (k - i + 1))
        assert p == pytest.approx(float(sum(w for w in weights.values() if w <= 1) / sum(weights.values())), rel=1e-11)
        for by, sign in ((1 - 1e-9, -1), (1 + 1e-9, 1)):  # the mean of the tilted distribution is the cell between these two
            assert sign * sum((i - a) * w * Decimal(odds * by) ** (i - a) for i, w in weights.items()) > 0
    assert got[2].p_value == pytest.approx(4e-9, rel=1e-8) and got[2].odds_ratio == pytest.approx(707106781.54, rel=1e-9)
    assert got[3].odds_ratio == float("inf")
