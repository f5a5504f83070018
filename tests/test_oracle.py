"""Every query with SQL against DuckDB on the smallest tables; the others must give rows without failing."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "year"):
        return str(v)[:10]
    try:
        return repr(round(float(v), 8) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def normal(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(shown(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
