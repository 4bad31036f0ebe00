"""Every query of the engine's own operators against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from casemill.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    """A value as a comparable one: numbers by 9 digits, arrays as tuples."""
    if v is None or isinstance(v, str | bool):
        return (0 if v is None else 1, str(v))
    if isinstance(v, list | tuple):
        return (3, tuple(map(plain, v)))
    if hasattr(v, "__float__"):
        return (2, "nan" if math.isnan(v) else f"{float(v):.9g}")
    return (1, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalog.ORACLES:
        assert got.columns
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())
