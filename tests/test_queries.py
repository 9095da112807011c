"""Every query that has SQL against DuckDB on the smallest tables; the rest must run."""

import math
from decimal import Decimal
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

SF = Path("/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = {n: f for n, f in entry.queries().items() if n in SQL or not n.startswith("p") or not n[1:2].isdigit()}
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in SQL:
        out = duck.sql(SQL[name])
        assert sorted(out.columns) == columns
        at = [out.columns.index(c) for c in columns]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
