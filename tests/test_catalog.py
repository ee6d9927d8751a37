"""Every catalog query against its DuckDB oracle on the smallest driver tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from adega.plans import catalog
from tests.conftest import SMOKE_DIR

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "pages"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(E.queries()) and set(catalog.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(want_cols)
    assert len(got) == len(want)
    assert _digest(df.columns, got) == _digest(want_cols, want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["country", "quantity_kg", "value_usd"]
    assert df.count() > 0
