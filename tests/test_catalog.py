"""Every query with SQL must equal DuckDB's result; the others must run."""

import math

import duckdb
import pytest

from stepquarry.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLE:
        rows = duck.sql(catalog.ORACLE[name])
        assert sorted(rows.columns) == columns
        at = [rows.columns.index(c) for c in columns]
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in rows.fetchall())
