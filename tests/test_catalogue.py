"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from lumenfold.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = catalogue.QUERIES[name](spark, SF)
    wanted = con.execute(catalogue.SQL[name])
    order = [x[0] for x in wanted.description]
    assert sorted(got.columns) == sorted(order)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in wanted.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
