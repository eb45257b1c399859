"""DuckDB twins of the registered queries (the correctness gate).

Written independently of the Spark code, in plain SQL over the driver's
pre-registered views; the two input tables are inlined as CTEs from the same
fixture expressions. Engine differences handled here (SURVEY section 5):
``SUM`` is cast to BIGINT, null order is spelled out, double-to-int casts use
``trunc`` first.
"""

from __future__ import annotations

from .sources.fixtures import (
    INCIDENTS_AS_OF, METRICS_AS_OF, incidents_cte, lookup_cte, metrics_cte, resolutions_cte,
)

INC_COLS = ("incident_id, workspace_id, team_name, job_name, root_cause, cause_category, "
            "confidence, suggested_fix, business_impact, auto_resolved, mttr_minutes, "
            "detected_at, detected_date, resolved_at, created_at")
MET_COLS = ("insight_id, workspace_id, cluster_name, metric_category, metric_name, "
            "metric_value, metric_unit, severity, anomaly_type, suggested_fix, "
            "business_impact, cause_category, confidence, timestamp")


def _w_inc(days: int) -> str:
    return f"detected_at >= DATE '{INCIDENTS_AS_OF}' - {int(days)}"


def _w_met(days: int) -> str:
    return f"timestamp >= DATE '{METRICS_AS_OF}' - {int(days)}"


def _cnt(cond: str) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def _inc(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join((incidents_cte(),) + extra_ctes)
    return f"WITH {ctes}\n{body}"


def _met(body: str) -> str:
    return f"WITH {metrics_cte()}\n{body}"


# Metric keys that also run over the whole history.
ALL_TIME = ("metric_kpis", "metric_count", "metrics_by_category", "metrics_by_severity", "metrics_by_workspace")
FAILING_OPEN = "cause_category IN ('OOM', 'CLUSTER_FAILURE') AND resolved_at IS NULL"
STRESS_OPEN = "cause_category = 'CLUSTER_FAILURE' AND resolved_at IS NULL"
HIGH_OPEN = "business_impact = 'high' AND resolved_at IS NULL"
SEV_IS = "upper(severity) = '{}'"
SEV_HIGH = "upper(severity) IN ('HIGH', 'CRITICAL')"

NEWEST = "ORDER BY detected_at DESC NULLS LAST, incident_id ASC NULLS FIRST"
NEWEST_M = "ORDER BY timestamp DESC NULLS LAST, insight_id ASC NULLS FIRST"


def _inc_page(days, status_sql, size, offset):
    return _inc(f"SELECT {INC_COLS} FROM incidents WHERE {_w_inc(days)}{status_sql} "
                f"{NEWEST} LIMIT {size} OFFSET {offset}")


def _met_filter(days, sev=None, cat=None):
    w = _w_met(days)
    if sev:
        w += f" AND upper(severity) = '{sev.upper()}'"
    if cat:
        w += f" AND metric_category = '{cat}'"
    return w


def build() -> dict[str, str]:
    lookup_rest = ", ".join(f"i.{c.strip()}" for c in INC_COLS.split(",")[1:])
    resolved_cols = ", ".join(
        "COALESCE(l.new_resolved_at, i.resolved_at) AS resolved_at" if c.strip() == "resolved_at"
        else f"i.{c.strip()}" for c in INC_COLS.split(","))
    sql = {
        "incident_list": _inc(f"SELECT * FROM incidents {NEWEST} LIMIT 50"),
        "incident_list_team": _inc(
            f"SELECT * FROM incidents WHERE team_name = 'team-3' {NEWEST} LIMIT 50"),
        "incident_lookup": _inc(
            "SELECT w.incident_id, i.incident_id IS NOT NULL AS found, " + lookup_rest +
            " FROM (SELECT DISTINCT incident_id FROM lookup_ids) w"
            " LEFT JOIN incidents i ON w.incident_id = i.incident_id", lookup_cte()),
        "incident_resolve": _inc(
            f"SELECT {resolved_cols} FROM incidents i LEFT JOIN "
            "(SELECT incident_id, max(resolved_at) AS new_resolved_at FROM resolutions "
            "GROUP BY incident_id) l ON i.incident_id = l.incident_id", resolutions_cte()),
        "incident_week_stats": _inc(
            "SELECT COUNT(*) AS total, "
            f"{_cnt('resolved_at IS NULL')} AS open_count, "
            f"{_cnt('auto_resolved = true')} AS auto_resolved, "
            "COUNT(DISTINCT cause_category) AS unique_categories "
            f"FROM incidents WHERE {_w_inc(7)}"),
        "overview_kpis": _inc(
            f"SELECT {_cnt('resolved_at IS NULL')} AS active_issues, "
            f"{_cnt(FAILING_OPEN)} AS pipelines_failing, "
            f"{_cnt(STRESS_OPEN)} AS clusters_stress, "
            "CAST(COALESCE(ROUND(AVG(CASE WHEN mttr_minutes IS NOT NULL AND mttr_minutes > 0 "
            "THEN mttr_minutes END), 0), 0) AS BIGINT) AS mttr_min, "
            "COUNT(*) AS total, "
            f"{_cnt('auto_resolved = true')} AS auto_resolved "
            f"FROM incidents WHERE {_w_inc(7)}"),
        "recent_open": _inc(
            f"SELECT {INC_COLS} FROM incidents WHERE {_w_inc(7)} AND resolved_at IS NULL "
            f"{NEWEST} LIMIT 5"),
        "incident_page": _inc_page(7, " AND resolved_at IS NULL", 20, 20),
        "incident_page_resolved": _inc_page(30, " AND resolved_at IS NOT NULL", 50, 100),
        "incident_page_all": _inc_page(7, "", 10, 0),
        "incident_count": _inc(
            f"SELECT COUNT(*) AS cnt FROM incidents WHERE {_w_inc(7)} AND resolved_at IS NULL"),
        "incident_count_resolved": _inc(
            f"SELECT COUNT(*) AS cnt FROM incidents WHERE {_w_inc(30)} "
            "AND resolved_at IS NOT NULL"),
        "failures_by_category": _inc(
            f"SELECT cause_category, COUNT(*) AS cnt FROM incidents WHERE {_w_inc(30)} "
            "GROUP BY cause_category ORDER BY cnt DESC, cause_category ASC NULLS FIRST LIMIT 8"),
        "failures_daily": _inc(
            f"SELECT detected_date, COUNT(*) AS cnt FROM incidents WHERE {_w_inc(14)} "
            "GROUP BY detected_date ORDER BY detected_date ASC NULLS FIRST"),
        "mttr_by_team": _inc(
            "SELECT team_name, ROUND(AVG(mttr_minutes) / 60, 1) AS hrs FROM incidents "
            f"WHERE mttr_minutes IS NOT NULL AND mttr_minutes > 0 AND {_w_inc(30)} "
            "GROUP BY team_name ORDER BY hrs DESC NULLS LAST, team_name ASC NULLS FIRST LIMIT 5"),
        "workspace_rollup": _inc(
            "SELECT workspace_id, "
            f"{_cnt('resolved_at IS NULL')} AS \"open\", "
            f"{_cnt('resolved_at IS NOT NULL')} AS resolved, "
            f"{_cnt(HIGH_OPEN)} AS crit "
            f"FROM incidents WHERE {_w_inc(7)} GROUP BY workspace_id"),
        # metrics
        "metric_kpis": _met(
            "SELECT COUNT(*) AS total, "
            f"{_cnt(SEV_IS.format('HIGH'))} AS high_sev, "
            f"{_cnt(SEV_IS.format('CRITICAL'))} AS critical_sev, "
            f"{_cnt(SEV_IS.format('MEDIUM'))} AS medium_sev, "
            "COUNT(DISTINCT workspace_id) AS workspaces, "
            "COUNT(DISTINCT metric_category) AS categories "
            f"FROM metric_insights WHERE {_w_met(90)}"),
        "metric_page": _met(
            f"SELECT {MET_COLS} FROM metric_insights WHERE {_met_filter(90)} "
            f"{NEWEST_M} LIMIT 20 OFFSET 20"),
        "metric_page_filtered": _met(
            f"SELECT {MET_COLS} FROM metric_insights WHERE {_met_filter(90, 'High', 'cat_3')} "
            f"{NEWEST_M} LIMIT 10"),
        "metric_count": _met(
            f"SELECT COUNT(*) AS cnt FROM metric_insights WHERE {_met_filter(90)}"),
        "metric_count_filtered": _met(
            f"SELECT COUNT(*) AS cnt FROM metric_insights "
            f"WHERE {_met_filter(90, 'High', 'cat_3')}"),
        "metric_categories": _met(
            "SELECT DISTINCT metric_category FROM metric_insights "
            f"WHERE {_w_met(90)} AND metric_category IS NOT NULL AND metric_category <> '' "
            "ORDER BY metric_category"),
        "metrics_by_category": _met(
            "SELECT metric_category, COUNT(*) AS cnt FROM metric_insights "
            f"WHERE {_w_met(90)} GROUP BY metric_category "
            "ORDER BY cnt DESC, metric_category ASC NULLS FIRST LIMIT 10"),
        "metrics_by_severity": _met(
            "SELECT upper(severity) AS severity, COUNT(*) AS cnt FROM metric_insights "
            f"WHERE {_w_met(90)} GROUP BY upper(severity)"),
        "metrics_by_workspace": _met(
            "SELECT workspace_id, COUNT(*) AS cnt, "
            f"{_cnt(SEV_HIGH)} AS high_cnt "
            f"FROM metric_insights WHERE {_w_met(90)} GROUP BY workspace_id "
            "ORDER BY cnt DESC, workspace_id ASC NULLS FIRST LIMIT 8"),
    }
    for name in ALL_TIME:
        sql[f"{name}_all_time"] = sql[name].replace(_w_met(90), _w_met(3650))
    return sql
