"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from opchain.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    df = QUERIES[name](spark, SF)
    want = tables.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda given: sorted((tuple(r[c] for c in columns) for r in given), key=repr)
    got = rows([r.asDict() for r in df.collect()])
    assert got == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
