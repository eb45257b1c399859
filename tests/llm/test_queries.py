"""The registered queries on the smallest driver tables, and their DuckDB twins."""

import duckdb
import pytest

import __spark_entry__ as entry

from ..conftest import SMALL

NAMES = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]


def test_all_are_registered():
    assert sorted(n.split("_")[0] for n in NAMES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 14))
    assert "pipeline" in NAMES


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_equals_duckdb(spark, name):
    df = entry.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_runs_whole(spark):
    rows = entry.queries()["pipeline"](spark, SMALL).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
