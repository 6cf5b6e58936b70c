"""Readers, writers and streams on files made here."""

import gzip
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.core import shared
from quarrystone.operators import sinks
from quarrystone.plans import catalogue
from quarrystone.sources import sequences as sq
from quarrystone.sources import tables as tb
from quarrystone.streaming import events as ev


def put(path, text):
    path.write_text(text)
    return str(path)


def test_tables(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "Orthogroup\ta\tb\tTotal\nOG1\t1\t2\t3\nOG2\t0\t1.0\t5\n")
    long, wrong = tb.counts_matrix(spark, p)
    assert {(r.family, r.species, r.n) for r in long.collect()} == {("OG1", "a", 1), ("OG1", "b", 2), ("OG2", "a", 0), ("OG2", "b", 1)}
    assert [r.family for r in wrong.collect()] == ["OG2"]
    with pytest.raises(ValueError):
        tb.tsv(spark, p, ["nothing"])
    kv = tb.key_values(spark, put(tmp_path / "kv.txt", "k\t1\nk\t2\nx\t3\n"))
    assert {(r.key, r.value) for r in kv.collect()} == {("k", "1"), ("x", "3")}


def test_annotations_and_domains(spark, tmp_path):
    rows, wrong = tb.mapper_annotations(spark, put(tmp_path / "e.tsv", "## c\n#query\tseed\nq1\ts1\t1e-5\nq1\ts2\n"))
    assert [r.seed_ortholog for r in rows.orderBy("seed_ortholog").collect()] == ["s1", "s2"] and wrong.count() == 1
    line = "Fam PF001.3 99 q1 - 120 1e-9 50.1 0.1 1 2 1e-8 1e-7 40.2 0.0 1 90 3 95 2 96 0.91 some words here"
    d = tb.domain_hits(spark, put(tmp_path / "d.txt", "# head\n" + line + "\n")).first()
    assert (d.query_id, d.pfam_accession, d.alignment_from, d.accuracy, d.description) == ("q1", "PF001", 3, 0.91, "some words here")


def test_ontology(spark, tmp_path):
    text = "format: 1\n\n[Term]\nid: GO:1\nname: one thing\nnamespace: bp\nalt_id: GO:9\n\n[Term]\nid: GO:2\nname: old\nnamespace: bp\nis_obsolete: true\n"
    terms, alt = tb.ontology(spark, put(tmp_path / "g.obo", text))
    assert [tuple(r) for r in terms.collect()] == [("GO:1", "one thing", "bp")] and [tuple(r) for r in alt.collect()] == [("GO:9", "GO:1")]


def test_gff_and_reports(spark, tmp_path):
    with gzip.open(tmp_path / "x.gff.gz", "wt") as f:
        f.write("##gff\nc1\ts\tCDS\t1\t9\t.\t+\t0\tID=a;Parent=b\nc1\ts\tgene\t1\t9\t.\t+\t.\tID=g\n")
    r = tb.coding_features(spark, str(tmp_path / "x.gff.gz")).collect()
    assert len(r) == 1 and r[0].attrs == {"ID": "a", "Parent": "b"}
    b = tb.completeness_reports(spark, put(tmp_path / "b.txt", "x\n C:95.1%[S:90.0%,D:5.1%],F:2.0%,M:2.9%,n:954 \n")).first()
    assert (b.complete, b.duplicated, b.n) == (95.1, 5.1, 954)
    t = tb.tree_reports(spark, put(tmp_path / "t.txt", "Best-fit model according to BIC: LG+G4\nLog-likelihood of the tree: -12.5 (s.e.)\n")).first()
    assert (t.best_model, t.log_likelihood, t.cpu_time) == ("LG+G4", "-12.5", None)
    assert [x.s for x in spark.createDataFrame([("1-02:03:04",), ("00:00:05",), ("x",)], "e string").select(tb.elapsed_seconds(F.col("e")).alias("s")).collect()] == [93784, 5, None]


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "s.fa", ">a first > thing\nMK*\nla\n>b\n\n>c x\nA\n")
    got = {r.id: (r.description, r.seq) for r in sq.fasta(spark, p, "protein").collect()}
    assert got == {"a": ("first > thing", "MKLA"), "b": ("", ""), "c": ("x", "A")}
    assert {r.id for r in sq.fasta_ids(spark, p).collect()} == {"a", "b", "c"}
    assert sq.fasta_of(spark, p, spark.createDataFrame([("c",)], "id string")).count() == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("n/cds_from_genomic.fna", ">l1 [protein_id=P1]\nAT\nG\n>l2 none\nA\n")
    assert [tuple(r)[1:] for r in sq.zipped_cds(spark, str(tmp_path / "z.zip")).collect()] == [("P1", "ATG")]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE merged (taxid_old INT, taxid_new INT)")
        db.execute("INSERT INTO merged VALUES (1, 2)")
    assert tuple(tb.sqlite_table(spark, str(tmp_path / "t.db"), "SELECT * FROM merged", "old bigint, new bigint").first()) == (1, 2)


def test_empty_and_broken_tables(spark, tmp_path):
    with pytest.raises(Exception):
        tb.tsv(spark, put(tmp_path / "empty.tsv", ""))
    (tmp_path / "odd.tsv").write_bytes(b"a\tb\nx\xff\t1\n")
    assert tb.tsv(spark, str(tmp_path / "odd.tsv")).first().a == "x\ufffd"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, "x"), ("b", None, "y")], "id string, v double, r string")
    sinks.write_tsv(df.coalesce(1), str(tmp_path / "t"), ["v", "id"], missing="NA")
    assert "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part*"))) == "v\tid\n1.5\ta\nNA\tb\n"
    with pytest.raises(Exception):
        sinks.write_tsv(df, str(tmp_path / "t"), ["id"])
    sinks.write_fasta(spark.createDataFrame([("s", "ACGTA")], "id string, seq string"), str(tmp_path / "f"), width=2)
    assert "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part*"))) == ">s\nAC\nGT\nA\n"
    assert sinks.write_routed(df, str(tmp_path / "r"), "r") == {"x": 1, "y": 1}
    assert sinks.commit(df, str(tmp_path / "c"), "1").count() == 2 and sinks.latest(spark, str(tmp_path / "c")).count() == 2
    assert all(len(r.sha256) == 64 for r in sinks.manifest(spark, str(tmp_path / "f"), "sha256").collect())
    assert df.select(sinks.python_format(F.col("v"), ".3f").alias("t")).first().t == "1.500"
    with pytest.raises(ValueError):
        sinks.all_pass(sinks.checks(spark, {"n": (1, 2)}))


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, float(i)) for i in range(10)], "s int, k int, value double").withColumn("ts", F.timestamp_seconds(F.col("s") * 600))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.committed(ev.windowed_detection(stream, "k", "value", (5.0,)), str(tmp_path / "out"), str(tmp_path / "ck"), "update")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("n"), F.sum("detected_0")).first()[:] == (10, 5)


def test_first_of_each_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d{i % 4}") for i in range(12)], "s int, digest string").withColumn("ts", F.timestamp_seconds(F.col("s") * 60))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.committed(ev.first_of_each(stream, "digest"), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    q.awaitTermination(120)
    assert sorted(r.digest for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["d0", "d1", "d2", "d3"]


def test_large_fasta_is_many_tasks(spark, tmp_path):
    """Records, some longer than a range, parted at any byte; no shuffle of the rows, and no join but with one row."""
    rows = {f"r{i}": "".join("ACDEFGHIKL"[(i * j) % 10] for j in range(20_000 if i % 50 == 0 else 300)) for i in range(2000)}
    (tmp_path / "big.fa").write_text("".join(f">{k} d > {k}\n" + "\r\n".join(v[a : a + 60] for a in range(0, len(v), 60)) + "\n" for k, v in rows.items()))
    (tmp_path / "small.fa").write_text(">only\nAC\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        got = sq.fasta(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 50
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastNestedLoopJoin" in plan
        assert {r.id: r.seq for r in got.collect()} == rows | {"only": "AC"}
        wanted = spark.createDataFrame([("r50",), ("r7",), (None,), ("no",)], "id string")
        assert {r.id: r.description for r in sq.fasta_of(spark, str(tmp_path), wanted).collect()} == {"r50": "d > r50", "r7": "d > r7"}
        (tmp_path / "bad.fa").write_text("ACGT\n" + (tmp_path / "big.fa").read_text())
        with pytest.raises(Exception, match="before the first record"):
            sq.fasta(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_value_wins_over_files(spark, tmp_path):
    """Larger files are read first; their lines still come later if their names do."""
    put(tmp_path / "a.txt", "k\tfirst\n")
    put(tmp_path / "b.txt", "k\tsecond\nm\tb\n" + "x\ty\n" * 5000)
    put(tmp_path / "c.txt", "m\tc\n" + "k\tthird\n" * 9000)
    for size in ("128m", "1000"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r.key: r.value for r in tb.key_values(spark, str(tmp_path)).collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == {"k": "first", "m": "b", "x": "y"}


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    path = put(tmp_path / "t.tsv", 'a\tb\n1\t"two\nlines ""x"""\n2\tplain\n')
    assert [tuple(r) for r in tb.tsv(spark, path).collect()] == [("1", 'two\nlines "x"'), ("2", "plain")]
    assert tb.tsv(spark, path, quoted=False).count() == 3


def test_one_job_writes_and_counts(spark, tmp_path):
    ran = []
    rows = spark.range(1000).withColumn("r", F.col("id") % 3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "observed")
    seen = sinks.observed_write(rows, str(tmp_path / "w"), {"n": F.count("*"), "most": F.max("id")}, "r")
    ran = tracker.getJobIdsForGroup("observed")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen == {"n": 1000, "most": 999} and len(ran) == 1 and spark.read.parquet(str(tmp_path / "w")).count() == 1000


def test_required_numbers(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "g string, _ok int")
    assert sinks.exactly(rows, ["g"], 2, 2).count() == 4 and sinks.exactly(rows, ["g"], 2, 2).columns == rows.columns
    for bad in (rows.limit(3), rows.where("g = 'a'"), rows.limit(0)):
        with pytest.raises(Exception, match="not 2 groups of 2 rows"):
            sinks.exactly(bad, ["g"], 2, 2).collect()
    got = sinks.measured({"n": (rows.agg(F.count("*")), 4), "none": (rows.where("_ok > 9").agg(F.max("_ok")), 9)})
    assert {(r.check, r.status, r.observed) for r in got.collect()} == {("n", "PASS", "4"), ("none", "FAIL", None)}


def test_scratch_tables_go(spark, tmp_path):
    with shared.scratch(spark):
        kept = shared.written(spark.range(5), "outer")
        with shared.scratch(spark):
            inner = shared.written(spark.range(3), "inner")
            assert inner.count() == 3 and kept.count() == 5
        assert not os.path.exists(inner.inputFiles()[0].removeprefix("file:").removeprefix("//")) and kept.count() == 5
        trees = catalogue.QUERIES["tree_closure"](spark, "/root/testdata/sf0.001")
        trees.write.parquet(str(tmp_path / "out"))
        folders = {os.path.dirname(f.removeprefix("file:").removeprefix("//")) for f in trees.inputFiles() if "/quarrystone/" in f}
    assert folders and not any(map(os.path.exists, folders)) and spark.read.parquet(str(tmp_path / "out")).count() > 0
    after = shared.written(spark.range(2), "after")
    assert after.count() == 2
