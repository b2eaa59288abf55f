"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import pytest

from siteloom.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for x in os.listdir(SF):
        c.execute(f"create view {x.removesuffix('.parquet')} as select * from '{SF}/{x}{'/*.parquet' if os.path.isdir(f'{SF}/{x}') else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")[:19]
    if isinstance(v, int):
        return v
    v = float(v)
    return None if math.isnan(v) else int(v) if v == int(v) else round(v, 5)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    cur = duck.execute(SQL[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == names
    want = sorted(repr(tuple(plain(r[order.index(c)]) for c in names)) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs_and_repeats(spark, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(map(repr, df.collect()))
    assert rows and rows == sorted(map(repr, QUERIES[name](spark, SF).collect()))
