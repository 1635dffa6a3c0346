"""Every query with SQL gives what DuckDB gives for that SQL on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quern.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)

    def plain(v):
        if pd.isna(v):
            return ""
        return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(([plain(v) for v in row] for row in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    a, b = same(ours), same(theirs)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-4, rel=1e-6) if all(isinstance(v, float) for v in x) else x == y or all(p == q or abs(p - q) < 2e-4 for p, q in zip(x, y) if isinstance(p, float))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
