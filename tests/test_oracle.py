"""Every registered query equals its DuckDB twin (the driver's gate, at sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from relyscope import registry
from tools.oracle_check import TABLES, rows_of

from .conftest import SMALL

QUERIES = {name: E.queries()[name] for name in registry.build()}
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    d_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(s_rows) == len(d_rows)
    assert rows_of(df.columns, s_rows) == rows_of(list(rel.columns), d_rows)


def test_entry_smoke(spark):
    out = E.entry(spark)
    rows = out.collect()
    assert len(rows) == 1
    assert out.columns == ["active_issues", "pipelines_failing", "clusters_stress", "mttr_min",
                           "total", "auto_resolved"]
