"""Queries on tables of which no row may be left out."""

import math
from collections import Counter

from pyspark.sql import functions as F

from quarrystone.functions import stats as st
from quarrystone.plans import catalogue

SF = "/root/testdata/sf0.001"


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_entropy_of_long_texts(spark, tmp_path):
    texts = {1: "Abba, abc 12", 2: "the quick brown fox " * 300, 3: "Zz" * 999 + "y", 4: "ab\n" * 5000, 5: "123"}
    stored(spark, tmp_path, "documents", list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.bits for r in catalogue.QUERIES["entropy_bits"](spark, str(tmp_path)).collect()}
    want = {}
    for doc, text in texts.items():
        n = Counter(c for c in text.lower() if "a" <= c <= "z")
        if n:
            want[doc] = -sum(k / n.total() * math.log2(k / n.total()) for k in n.values())
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_places(spark):
    rows = [(i, i % 3, [1.5, 2.0, -1.0, 7.25, float(i)][i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "family int, tier int, score double")
    got = {r.family: r.place for r in st.places(df, F.col("tier"), F.desc("score"), F.col("family")).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], -r[2], r[0])), 1)}
    assert st.places(df.limit(0), F.col("tier"), F.desc("score"), F.col("family")).count() == 0


def test_family_ranked_has_every_family(spark):
    got = catalogue.QUERIES["family_ranked"](spark, SF).collect()
    families = {r.family for r in catalogue.QUERIES["change_events"](spark, SF).select("family").distinct().collect()}
    tiers = {"high": 0, "fdr_supported": 1, "candidate": 2, "family_only": 3}
    assert len(got) == len(families) > 100 and {r.family for r in got} == families
    want = sorted(got, key=lambda r: (tiers[r.tier], -r.score, r.family))
    assert [r.place for r in want] == list(range(1, len(got) + 1))


def test_union_takes_later_turns(spark, tmp_path):
    stored(spark, tmp_path, "documents", [(1, "a"), (2, "b")], "doc_id bigint, text string")
    stored(spark, tmp_path, "benchmark", [(1, "a")], "item_id bigint, text string")
    stored(spark, tmp_path, "conversations", [(1, 0, "a"), (1, 1, "c"), (3, 0, "d"), (3, 1, "d"), (4, 2, "e")], "conv_id bigint, turn int, text string")
    got = {(r.id, r.sources, r.conflicts) for r in catalogue.QUERIES["union_distinct_sources"](spark, str(tmp_path)).collect()}
    assert got == {(1, "benchmark;conversations;documents", 1), (2, "documents", 0), (3, "conversations", 0), (4, "conversations", 0)}
