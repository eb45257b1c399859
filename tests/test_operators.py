"""Hand-made rows for rules the fixture data does not reach."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from relyscope.operators import detail as D
from relyscope.operators import incidents as I
from relyscope.operators import insights as N
from relyscope.operators import metrics as M
from relyscope.operators import paging as P
from relyscope.operators import resolve as R
from relyscope.functions.derived import auto_flag, confidence_pct, incident_status, mttr_text
from relyscope.sources.fixtures import load_incidents, load_metrics
from relyscope.sources.schemas import INCIDENT_COLUMNS

from .conftest import SMALL

SCHEMA = ("incident_id string, workspace_id string, team_name string, job_name string, "
          "root_cause string, cause_category string, confidence double, suggested_fix string, "
          "business_impact string, auto_resolved boolean, mttr_minutes int, "
          "detected_at timestamp_ntz, detected_date date, resolved_at timestamp_ntz, "
          "created_at timestamp_ntz")
AS_OF = dt.date(2024, 1, 31)


def inc_row(i, at, resolved=None, cat="OOM", ws="ws-1", team="t", impact="high", mttr=None,
            auto=None, conf=0.5):
    return (f"INC-{i}", ws, team, f"job-{i}", "cause", cat, conf, "fix", impact, auto, mttr,
            at, at.date() if at else None, resolved, at + dt.timedelta(minutes=2) if at else None)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_window_boundaries(spark):
    start = dt.datetime(2024, 1, 24)  # as_of - 7 days, midnight
    rows = [inc_row(1, start), inc_row(2, start - dt.timedelta(seconds=1)),
            inc_row(3, dt.datetime(2024, 3, 1)), inc_row(4, dt.datetime(2024, 1, 30, 23, 59))]
    out = I.incident_count(frame(spark, rows), as_of=AS_OF, days=7, status="All").first()
    assert out.cnt == 3  # midnight included, one second before excluded, future counted


def test_empty_input_gives_zero_row(spark):
    empty = frame(spark, [])
    k = I.overview_kpis(empty, as_of=AS_OF).collect()
    assert len(k) == 1 and tuple(k[0]) == (0, 0, 0, 0, 0, 0)
    s = I.incident_week_stats(empty, as_of=AS_OF).first()
    assert tuple(s) == (0, 0, 0, 0)


def test_overview_kpis_rules(spark):
    at = dt.datetime(2024, 1, 30)
    rows = [inc_row(1, at, cat="OOM"), inc_row(2, at, cat="CLUSTER_FAILURE"),
            inc_row(3, at, cat="CLUSTER_FAILURE", resolved=at, mttr=0),
            inc_row(4, at, cat=None, resolved=at, mttr=30, auto=True),
            inc_row(5, at, cat="TIMEOUT", resolved=at, mttr=61)]
    k = I.overview_kpis(frame(spark, rows), as_of=AS_OF).first().asDict()
    assert k == {"active_issues": 2, "pipelines_failing": 2, "clusters_stress": 1,
                 "mttr_min": 46, "total": 5, "auto_resolved": 1}  # zero minutes excluded


def test_null_keys_stay_one_group(spark):
    at = dt.datetime(2024, 1, 30)
    rows = [inc_row(1, at, cat=None), inc_row(2, at, cat=None), inc_row(3, at, cat="OOM")]
    got = {r.cause_category: r.cnt for r in I.failures_by_category(frame(spark, rows), as_of=AS_OF).collect()}
    assert got == {None: 2, "OOM": 1}


def test_open_plus_resolved_is_total(spark):
    inc = load_incidents(spark, SMALL)
    ws = I.workspace_rollup(inc, as_of="2024-01-31", days=30).agg(
        F.sum("open").alias("o"), F.sum("resolved").alias("r")).first()
    total = I.incident_count(inc, as_of="2024-01-31", days=30, status="All").first().cnt
    assert ws.o + ws.r == total


def test_pages_concatenate_to_sorted_list(spark):
    inc = load_incidents(spark, SMALL)
    full = [r.incident_id for r in I.incident_page(inc, as_of="2024-01-31", days=30,
                                                   status="All", page_size=100000).collect()]
    got = []
    for p in range(0, len(full) // 50 + 1):
        got += [r.incident_id for r in I.incident_page(inc, as_of="2024-01-31", days=30,
                                                       status="All", page_size=50,
                                                       offset=p * 50).collect()]
    assert got == full and len(full) == 1000


def test_keyset_page_follows_offset_page(spark):
    inc = load_incidents(spark, SMALL)
    first = I.incident_page(inc, as_of="2024-01-31", days=30, status="All", page_size=20).collect()
    second = I.incident_page(inc, as_of="2024-01-31", days=30, status="All", page_size=20,
                             offset=20).collect()
    last = first[-1]
    after = I.incident_page_after(inc, last.detected_at, last.incident_id, as_of="2024-01-31",
                                  days=30, status="All", page_size=20).collect()
    assert [r.incident_id for r in after] == [r.incident_id for r in second]


def test_metric_keyset_page_follows_offset_page(spark):
    from relyscope.sources.fixtures import load_metrics
    m = load_metrics(spark, SMALL)
    first = M.metric_page(m, as_of="2001-11-05", days=90, page_size=15).collect()
    second = M.metric_page(m, as_of="2001-11-05", days=90, page_size=15, offset=15).collect()
    after = M.metric_page_after(m, first[-1].timestamp, first[-1].insight_id, as_of="2001-11-05",
                                days=90, page_size=15).collect()
    assert [r.insight_id for r in after] == [r.insight_id for r in second]


@pytest.mark.parametrize("total,size,asked", [(0, 20, 0), (1, 20, 5), (95, 20, 2), (100, 20, 9),
                                               (1000, 50, 3)])
def test_page_summary(spark, total, size, asked):
    counts = spark.createDataFrame([(total,)], "cnt bigint")
    r = P.page_summary(counts, page_size=size, page=asked).first()
    pages = max(1, -(-total // size))
    assert r.pages == pages and r.page == min(asked, pages - 1)
    assert r.lo == r.page * size + 1 and r.hi == min((r.page + 1) * size, total)
    covered = []
    for p in range(pages):
        q = P.page_summary(counts, page_size=size, page=p).first()
        covered += list(range(q.lo, q.hi + 1))
    assert covered == list(range(1, total + 1))


def test_daily_trend_edges(spark):
    days = [(dt.date(2024, 1, d), d) for d in range(1, 16)]
    out = N.daily_trend(spark.createDataFrame(days, "detected_date date, cnt bigint")).collect()
    assert len(out) == 14 and min(r.detected_date for r in out) == dt.date(2024, 1, 2)
    latest = [r for r in out if r.is_latest]
    assert len(latest) == 1 and latest[0].cnt == 15 and latest[0].latest_cnt == 15
    assert out[0].avg_cnt == 8.0 and all(r.above_avg for r in out)
    only_null = spark.createDataFrame([(None, 4)], "detected_date date, cnt bigint")
    r = N.daily_trend(only_null).first()
    assert r.is_latest and r.latest_cnt == 4 and r.bar_height == 100 and not r.above_avg


def test_workspace_health_states_add_up(spark):
    inc = load_incidents(spark, SMALL)
    roll = I.workspace_rollup(inc, as_of="2024-01-31", days=7)
    s = N.workspace_health_summary(roll).first()
    assert s.healthy + s.degraded + s.critical == s.workspaces == roll.count()
    assert (s.healthy, s.degraded, s.critical) == (4, 4, 4)  # FIXTURES.md


def test_derived_values(spark):
    df = spark.createDataFrame(
        [(0.29, True, 35, None, "TIMEOUT"), (float("nan"), None, 0, None, None),
         (None, False, None, dt.datetime(2024, 1, 1), "network"), (float("inf"), True, 7, None, "OOM")],
        "c double, a boolean, m int, r timestamp_ntz, cat string")
    got = df.select(confidence_pct("c").alias("p"), auto_flag("a").alias("f"),
                    mttr_text("m").alias("t"), incident_status("cat", "r").alias("s")).collect()
    assert [tuple(r) for r in got] == [
        (28, True, "35 min", "DELAYED"), (0, False, "—", "FAILED"),
        (0, False, "—", "RESOLVED"), (0, True, "7 min", "FAILED")]


def test_timeline_shapes(spark):
    at = dt.datetime(2024, 1, 30, 10, 5)
    rows = [inc_row(1, at, cat="PERMISSION"), inc_row(2, at, cat="oom", resolved=at, auto=True),
            inc_row(3, at, cat=None, resolved=at)]
    tl = D.incident_timeline(frame(spark, rows)).orderBy("incident_id", "seq").collect()
    by = {}
    for r in tl:
        by.setdefault(r.incident_id, []).append((r.seq, r.tone, r.event, r.time_text))
    assert [e[2] for e in by["INC-1"]] == ["Pipeline run triggered on schedule",
                                          "Access denied — credentials expired",
                                          "AI diagnosis job analysed and logged failure",
                                          "Awaiting SRE resolution"]
    assert by["INC-1"][-1][3] == "Ongoing" and by["INC-1"][2][3] == "2024-01-30 10:07"
    assert len(by["INC-2"]) == 5 and by["INC-2"][-1][2] == "Auto-resolved ✓"
    assert by["INC-3"][1][2] == "Pipeline failed — see root cause"
    assert by["INC-3"][-1][2] == "Manually resolved by SRE ✓"


def test_resolve_rules(spark, tmp_out):
    at = dt.datetime(2024, 1, 30)
    old = dt.datetime(2024, 1, 30, 1)
    inc = frame(spark, [inc_row(1, at), inc_row(2, at, resolved=old, mttr=60), inc_row(3, at)])
    t1, t2 = dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 2)
    req = spark.createDataFrame([("INC-1", t1), ("INC-1", t2), ("INC-2", t1), ("INC-9", t1)],
                                "incident_id string, resolved_at timestamp_ntz")
    out = {r.incident_id: r for r in R.resolve_incidents(inc, req).collect()}
    assert out["INC-1"].resolved_at == t2          # latest request wins
    assert out["INC-2"].resolved_at == t1          # re-resolve overwrites
    assert out["INC-2"].mttr_minutes == 60         # other columns untouched
    assert out["INC-3"].resolved_at is None
    assert [r.incident_id for r in R.unmatched_resolutions(inc, req).collect()] == ["INC-9"]
    now_req = spark.createDataFrame([("INC-3", None)], "incident_id string, resolved_at timestamp_ntz")
    assert R.resolve_incidents(inc, now_req).where("incident_id = 'INC-3'").first().resolved_at
    path = os.path.join(tmp_out, "snap")
    R.write_resolved_snapshot(inc, req, path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and set(back.columns) == set(INCIDENT_COLUMNS)
    with pytest.raises(Exception):
        R.write_resolved_snapshot(inc, req, path)  # never over an existing snapshot


def test_lookup_list_and_large_batch(spark):
    at = dt.datetime(2024, 1, 30)
    inc = frame(spark, [inc_row(1, at), inc_row(2, at)])
    got = {r.incident_id: r.found for r in I.incident_lookup(inc, ["INC-1", "INC-7"]).collect()}
    assert got == {"INC-1": True, "INC-7": False}
    assert I.incident_lookup(inc, []).count() == 0


def test_lookup_of_a_repeated_id_answers_with_its_newest_row(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 30)
    inc = frame(spark, [inc_row(1, old), inc_row(1, new), inc_row(2, old)])
    rows = I.incident_lookup(inc, ["INC-1"]).collect()
    assert [(r.incident_id, r.detected_at) for r in rows] == [("INC-1", new)]


def test_resolved_partitions_hold_touched_days_only(spark, tmp_out):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    inc = frame(spark, [inc_row(i, at) for i, at in enumerate(days + days)])
    req = spark.createDataFrame([("INC-1", dt.datetime(2024, 2, 1))], "incident_id string, resolved_at timestamp_ntz")
    path = R.write_resolved_partitions(inc, req, os.path.join(tmp_out, "days"))
    back = spark.read.parquet(path)
    assert {r.incident_id for r in back.collect()} == {"INC-1", "INC-4"}
    assert back.where("incident_id = 'INC-1'").first().resolved_at == dt.datetime(2024, 2, 1)


def test_display_order_of_workspaces_and_severities(spark):
    ws = I.workspace_rollup(load_incidents(spark, SMALL), as_of="2024-01-31", days=30).collect()
    assert [(-r.open, r.workspace_id) for r in ws] == sorted((-r.open, r.workspace_id) for r in ws)
    sev = M.metrics_by_severity(load_metrics(spark, SMALL), as_of="2001-11-05", days=3650).collect()
    assert [-r.cnt for r in sev] == sorted(-r.cnt for r in sev) and len(sev) > 3


def test_metric_filters_case_rules(spark):
    rows = [("a", "ws", "c", "cat_1", "m", 1.0, "", "High", "SPIKE", None, None, "OOM", 0.1,
             dt.datetime(2001, 11, 4)),
            ("b", "ws", "c", "Cat_1", "m", 2.0, "%", "HIGH", "DROP", None, None, "OOM", 0.1,
             dt.datetime(2001, 11, 4))]
    m = spark.createDataFrame(rows, (
        "insight_id string, workspace_id string, cluster_name string, metric_category string, "
        "metric_name string, metric_value double, metric_unit string, severity string, "
        "anomaly_type string, suggested_fix string, business_impact string, "
        "cause_category string, confidence double, timestamp timestamp_ntz"))
    assert M.metric_count(m, as_of="2001-11-05", days=1, severity="high").first().cnt == 2
    assert M.metric_count(m, as_of="2001-11-05", days=1, category="cat_1").first().cnt == 1
    assert M.metric_kpis(m, as_of="2001-11-05", days=1).first().high_sev == 2


def test_status_page_summaries_agree_with_counts(spark):
    inc = load_incidents(spark, SMALL)
    rows = {r.status: r for r in P.status_page_summaries(
        inc, as_of="2024-01-31", days=30, page_size=20, open_page=2, resolved_page=99).collect()}
    o = I.incident_count(inc, as_of="2024-01-31", days=30, status="Open only").first().cnt
    r = I.incident_count(inc, as_of="2024-01-31", days=30, status="Resolved only").first().cnt
    a = I.incident_count(inc, as_of="2024-01-31", days=30, status="All").first().cnt
    assert rows["Open only"].total == o and rows["Resolved only"].total == r and o + r == a
    assert rows["Open only"].page == 2 and rows["Resolved only"].page == rows["Resolved only"].pages - 1
