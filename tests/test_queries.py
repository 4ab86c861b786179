"""Every query with a DuckDB equivalent gives the same rows at the smallest scale; the others give rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lumera.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: "" if v is None else str(v) if isinstance(v, str | bool) else repr(float(v) + 0.0)
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    assert got and not any(v is None for r in got for v in r)
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(list(want.columns), want.fetchall())


def test_entry_points(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert entry.entry(spark).count() == 1000
