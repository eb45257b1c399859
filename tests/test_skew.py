"""A key holding a third of all rows: results stay exact and the hot key is
combined map-side before any shuffle (no raw hot rows reach one task)."""

import datetime as dt

from pyspark.sql import functions as F

from relyscope.operators import incidents as I
from relyscope.operators import resolve as R
from relyscope.sources.fixtures import load_incidents

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_workspace(spark):
    inc = load_incidents(spark, SMALL).withColumn(
        "workspace_id",
        F.when(F.abs(F.hash("incident_id")) % 3 == 0, F.lit("ws-hot")).otherwise(F.col("workspace_id")))
    out = I.workspace_rollup(inc, as_of="2024-01-31", days=30)
    got = {r.workspace_id: (r.open, r.resolved) for r in out.collect()}
    rows = inc.select("workspace_id", "resolved_at").collect()
    expect = {}
    for r in rows:
        o, c = expect.get(r.workspace_id, (0, 0))
        expect[r.workspace_id] = (o + (r.resolved_at is None), c + (r.resolved_at is not None))
    assert got == expect and sum(got["ws-hot"]) > len(rows) / 4
    p = plan(out)
    # partial aggregate sits below the shuffle on the key
    assert p.index("partial_sum") > p.index("Exchange hashpartitioning(workspace_id")


def test_hot_resolution_id(spark):
    inc = load_incidents(spark, SMALL)
    hot = inc.where("resolved_at IS NULL").first().incident_id
    base = dt.datetime(2024, 2, 1)
    req = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("INC-x"), F.col("id")))
        .alias("incident_id"),
        (F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id")))
        .alias("resolved_at"))
    latest = R.latest_requests(inc, req)
    p = plan(latest)
    assert p.index("partial_max") > p.index("Exchange hashpartitioning(incident_id")
    out = R.resolve_incidents(inc, req).where(F.col("incident_id") == hot).first()
    assert out.resolved_at == base + dt.timedelta(minutes=2997)
