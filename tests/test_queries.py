"""Every catalogue query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from siftwright.plans import delivery_queries as delivery_queries
from siftwright.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    """A value as text; numbers of whatever type as one."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if type(v).__name__ == "Decimal" or isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    rel = db.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    assert got and got == want
