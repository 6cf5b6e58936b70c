"""The registered queries with SQL against DuckDB, and the recall of the index on the driver's vectors."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarrystone.llm import registry

ROOT = "/root/testdata"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_as_sql(spark, name, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{ROOT}/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = registry.QUERIES[name](spark, f"{ROOT}/{sf}")
    want = con.execute(registry.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_recall_of_the_index(spark):
    got = defaultdict(set)
    for r in registry.QUERIES["op7_hash_forest"](spark, f"{ROOT}/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    rows = spark.read.parquet(f"{ROOT}/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], "f8")
    hits = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        near = x @ x[ids == q][0]
        near[ids == q] = -np.inf
        hits += len(found & set(ids[np.lexsort((ids, -near))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)
