from __future__ import annotations

import os

import pytest

from prismal.plans import queries as Q
from prismal.plans import raster_queries  # noqa: F401  adds to the same tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return con


def rows(names, columns, data):
    order = [columns.index(c) for c in names]
    value = lambda x: float(x) if type(x).__name__ == "Decimal" else x
    return sorted((tuple(value(r[k]) for k in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    assert rows(names, df.columns, df.collect()) == rows(names, list(want.columns), want.fetchall())
