"""Every query of the reference operators against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from umbra.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLE:
        assert got
        return
    q = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in q.fetchall()), key=str)
