"""Every registered query of the engine against DuckDB on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quarrystone.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def table(df):
    def cell(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if name in catalogue.ORACLE_SQL:
        duck.execute(catalogue.ORACLE_SQL[name])
        want = duck.fetchdf()
        assert sorted(rows.columns) == sorted(want.columns)
        assert table(rows) == table(want)
