"""Physical plan shapes that the design relies on."""

from relyscope import registry
from relyscope.operators import detail as D
from relyscope.operators import incidents as I
from relyscope.operators import insights as N
from relyscope.operators import metrics as M
from relyscope.operators import resolve as R
from relyscope.plans import rollup as RU
from relyscope.sources.fixtures import (
    load_incidents, load_lookup_ids, load_metrics, resolutions_from_incidents,
)

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_filter_reaches_scan(spark):
    p = plan(I.overview_kpis(load_incidents(spark, SMALL), as_of="2024-01-31"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-24T00:00)]" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p


def test_metric_scan_prunes_columns(spark):
    p = plan(M.metrics_by_severity(load_metrics(spark, SMALL), as_of="2001-11-05", days=90))
    assert "GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in p


def test_pages_are_top_k(spark):
    inc = load_incidents(spark, SMALL)
    p = plan(I.incident_page(inc, as_of="2024-01-31", page_size=20, offset=40))
    assert "TakeOrderedAndProject(limit=60, offset=40" in p
    assert "TakeOrderedAndProject(limit=8" in plan(I.failures_by_category(inc, as_of="2024-01-31"))


def test_keyed_aggregates_combine_before_shuffle(spark):
    p = plan(I.workspace_rollup(load_incidents(spark, SMALL), as_of="2024-01-31"))
    assert p.count("HashAggregate") >= 2 and "partial_sum" in p


def test_lookup_joins_without_hints(spark):
    """Static sizes decide: with broadcasts off both joins are merge joins and the
    wide rows are filtered by the request first."""
    inc = load_incidents(spark, SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lookup = plan(I.incident_lookup(inc, load_lookup_ids(spark, SMALL)))
        resolved = plan(R.resolve_incidents(inc, resolutions_from_incidents(inc)))
        unmatched = plan(R.unmatched_resolutions(inc, load_lookup_ids(spark, SMALL)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in lookup and "Broadcast" not in lookup
    assert "SortMergeJoin" in resolved and "Broadcast" not in resolved
    assert "LeftAnti" in unmatched and "Broadcast" not in unmatched


def test_per_row_views_do_not_shuffle(spark):
    inc, met = load_incidents(spark, SMALL), load_metrics(spark, SMALL)
    q = registry.build()
    views = [D.incident_display(inc), D.incident_detail(inc), D.incident_timeline(inc),
             D.metric_display(met), D.metric_detail(met), D.metric_timeline(met)]
    views += [q[name](spark, SMALL) for name in ("incident_status", "clean_text", "business_impact")]
    assert all("Exchange" not in plan(v) for v in views)


def test_reliability_summary_has_no_join(spark):
    p = plan(N.reliability_summary(load_incidents(spark, SMALL), load_metrics(spark, SMALL),
                                   as_of="2024-01-31", metrics_as_of="2001-11-05"))
    assert "Join" not in p and "Union" in p


def test_page_answers_have_no_unbounded_single_task_window(spark):
    inc, met = load_incidents(spark, SMALL), load_metrics(spark, SMALL)
    for page in (RU.insights_answers(inc, as_of="2024-01-31", days=7),
                 M.metrics_page_answers(met, as_of="2001-11-05", days=90)):
        assert "Window" not in plan(page)


def test_rollup_answers_read_their_window_only(spark, tmp_out):
    inc = load_incidents(spark, SMALL)
    p = plan(registry.build()["overview_kpis_from_rollup"](spark, SMALL))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in p
    stored = spark.read.parquet(RU.write_rollup(RU.incident_daily_rollup(inc), tmp_out + "/rollup"))
    p = plan(RU.workspace_rollup(stored, as_of="2024-01-31", days=7))
    assert "PartitionFilters: [isnotnull(day" in p and ">= 2024-01-24" in p
