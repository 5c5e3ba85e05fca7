"""Every registered query equals its DuckDB oracle (small scale)."""

import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from sphaera.session import TABLES

from conftest import SF_SMALL

ORACLES = oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = _rows(df.collect(), cols)
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    want = _rows(cur.fetchall(), ocols)
    assert sorted(cols) == sorted(ocols)
    assert len(got) == len(want)
    assert got == want


def test_every_query_runs_without_oracle(spark):
    for name, fn in queries().items():
        if name in ORACLES or name.startswith("t8") or name.startswith("t9_fit"):
            continue
        assert fn(spark, SF_SMALL).count() > 0, name
