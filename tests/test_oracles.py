"""Every registered query against its SQL counterpart; a comparison of nothing with nothing fails."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_points

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, DIR)
    result = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in result.fetchall())
    assert want and sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


def test_entry_returns_rows(spark):
    assert entry_points.entry(spark).count() > 0
