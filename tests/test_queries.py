"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pixelquarry import registry
from pixelquarry.plans.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in cursor.fetchall())
    assert sorted([plain(r[c]) for c in sorted(names)] for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
