"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def canonical(frame):
    def cell(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        if pd.isna(v):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    return cols, sorted((tuple(cell(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = canonical(entry.queries()[name](spark, DATA).toPandas())
    assert got == canonical(duck.execute(entry.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    if DATA == "/root/testdata/sf0.001":
        assert entry.entry(spark).count() > 0
