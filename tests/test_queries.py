"""Every query with a SQL counterpart gives the same rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = {n: f for m in entry._modules() if not m.__name__.startswith("siltbed.llm") for n, f in m.queries().items()}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in CORE}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = CORE[name](spark, SF)
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert found == _rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert CORE[name](spark, SF).count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
