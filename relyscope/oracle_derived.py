"""DuckDB twins of the derived-value queries.

Plain SQL restatements of the reference's per-row rules (SURVEY 2.4, 2.8-2.10),
written as staged CTEs. Regex patterns use the same explicit whitespace class
as the Spark side (RE2 and Java read it alike).
"""

from __future__ import annotations

from . import oracle
from .functions.text import WS
from .oracle import (
    FAILING_OPEN, HIGH_OPEN, SEV_HIGH, STRESS_OPEN, _cnt, _inc, _met, _w_inc, _w_met,
)
from .sources.fixtures import RAW_IMPACT, RAW_TEXT, incidents_cte, lookup_cte, metrics_cte

DASH = "—"
OPEN_IS_ZERO = '"open" = 0'
DEGRADED = '"open" > 0 AND crit = 0'


def strip(x: str) -> str:
    return "regexp_replace(" + x + r", '\A" + WS + "+|" + WS + r"+\z', '', 'g')"


def clean(x: str) -> str:
    t = strip(x)
    s = "regexp_replace(" + t + r", '\A\{[^}]*\}" + WS + "*', '')"
    s = "regexp_replace(" + s + ", '" + WS + r"*\{[^}]*\}\z', '')"
    s = "regexp_replace(" + s + r", '\{[^}]{0,200}\}', '', 'g')"
    s = "regexp_replace(" + s + r", '\*+', '', 'g')"
    s = "trim(regexp_replace(" + s + ", '" + WS + "+', ' ', 'g'))"
    return (f"(CASE WHEN {x} IS NULL OR {t} IN ('', 'None', 'nan', 'NaT', '<NA>') THEN '{DASH}' "
            f"WHEN {s} = '' THEN '{DASH}' ELSE {s} END)")


def _met_body(sql: str) -> str:
    """A metric twin's query without its shared ``WITH metric_insights`` prefix."""
    prefix = f"WITH {metrics_cte()}\n"
    assert sql.startswith(prefix)
    return sql[len(prefix):]


def minute(x: str) -> str:
    return f"coalesce(strftime({x}, '%Y-%m-%d %H:%M'), '')"


def text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def status(cat="cause_category", res="resolved_at") -> str:
    return (f"CASE WHEN {res} IS NOT NULL THEN 'RESOLVED' WHEN upper({cat}) IN "
            "('TIMEOUT', 'NETWORK', 'DEPENDENCY') THEN 'DELAYED' ELSE 'FAILED' END")


def conf_pct(x="confidence") -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0 "
            f"ELSE coalesce(TRY_CAST(trunc({x} * 100) AS BIGINT), 0) END")


def auto_flag(x="auto_resolved") -> str:
    return f"coalesce(lower(CAST({x} AS VARCHAR)) IN ('true', '1', 'yes'), false)"


def mttr_text(x="mttr_minutes") -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '{DASH}' "
            f"ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) || ' min' END")


# ---- D4 -----------------------------------------------------------------------

def _value(k: str) -> str:
    """A field's JSON; of a key given twice the last one."""
    at = f"len(json_keys(v)) + 1 - list_position(list_reverse(json_keys(v)), '{k}')"
    return f"list_extract(json_extract(v, '$.*'), {at})"


def _truthy(k: str) -> str:
    j = _value(k)
    return (f"({j} IS NOT NULL AND CAST({j} AS VARCHAR) NOT IN ('false', 'null', '\"\"', '[]', '{{}}') "
            f"AND coalesce(TRY_CAST(CAST({j} AS VARCHAR) AS DOUBLE) <> 0, true))")


def _json_text(k: str) -> str:
    plain = f"json_extract_string({_value(k)}, '$')"
    return f"CASE WHEN json_type({_value(k)}) = 'DOUBLE' THEN CAST(CAST({plain} AS DOUBLE) AS VARCHAR) ELSE {plain} END"


def _first(*keys: str) -> str:
    return "coalesce(" + ", ".join(
        f"CASE WHEN {_truthy(k)} THEN {_json_text(k)} END" for k in keys) + ")"


def impact_ctes(src: str) -> str:
    """CTEs ``imp0..imp3`` over ``src(key..., level, impact, fix, cause)``.

    ``imp3`` adds impact_level, sla_at_risk, impact_severity, impact_desc.
    """
    frag = r"regexp_extract(raw, '\{[^}]+\}')"
    return f"""imp0 AS (
  SELECT *, CASE WHEN level IS NULL OR level = '' THEN 'medium' ELSE {strip('lower(level)')} END AS lvl0,
    {strip("coalesce(impact, '')")} AS raw, {clean('fix')} AS fc, {clean('cause')} AS cc
  FROM {src}),
imp1 AS (
  SELECT *, CASE WHEN raw LIKE '{{%' THEN CASE
      WHEN json_valid(raw) THEN CAST(raw AS JSON)
      WHEN {frag} <> '' AND json_valid({frag}) THEN CAST({frag} AS JSON) END END AS v0
  FROM imp0),
imp2 AS (
  SELECT *, CASE WHEN v0 IS NOT NULL AND json_type(v0) = 'OBJECT' AND len(json_keys(v0)) > 0
                 THEN v0 END AS v
  FROM imp1),
imp2b AS (
  SELECT *, v IS NOT NULL AS parsed,
    coalesce({_truthy('SLA_AT_RISK')} OR {_truthy('sla_at_risk')}, false) AS sla,
    upper(coalesce({_first('SEVERITY', 'severity')}, '')) AS sev,
    {_first('MESSAGE', 'message', 'DESCRIPTION', 'description')} AS msg,
    {_first('AFFECTED_PIPELINES', 'affected_pipelines')} AS affected,
    {_first('REGION', 'region')} AS region,
    {_first('TEAM', 'team')} AS team
  FROM imp2),
imp3 AS (
  SELECT *,
    CASE WHEN parsed AND lvl0 IN ('nan', 'none', '', 'low') AND sev <> ''
         THEN CASE sev WHEN 'CRITICAL' THEN 'high' WHEN 'HIGH' THEN 'high'
                       WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE lvl0 END
         ELSE lvl0 END AS impact_level,
    parsed AND sla AS sla_at_risk,
    CASE WHEN parsed THEN sev ELSE '' END AS impact_severity,
    CASE WHEN parsed THEN
      CASE WHEN msg IS NOT NULL OR affected IS NOT NULL OR region IS NOT NULL OR team IS NOT NULL OR sla
           THEN concat_ws(' ', msg,
                  CASE WHEN affected IS NOT NULL THEN 'Affected pipelines: ' || affected || '.' END,
                  CASE WHEN region IS NOT NULL THEN 'Region: ' || region || '.' END,
                  CASE WHEN team IS NOT NULL THEN 'Owning team: ' || team || '.' END,
                  CASE WHEN sla AND msg IS NULL THEN 'Pipeline is breaching agreed service levels.' END)
           WHEN fc <> '{DASH}' AND length(fc) > 20 THEN fc
           WHEN cc <> '{DASH}' THEN cc
           ELSE 'Review the root cause and apply the suggested fix.' END
    ELSE
      CASE WHEN raw <> '' AND raw NOT IN ('{DASH}', 'None', 'nan') AND NOT raw LIKE '{{%' THEN raw
           WHEN fc <> '{DASH}' AND length(fc) > 20 THEN fc
           WHEN cc <> '{DASH}' AND length(cc) > 15 THEN cc
           WHEN lvl0 = 'high' THEN 'Critical failure — downstream consumers blocked, data not updating.'
           WHEN lvl0 = 'medium' THEN 'Pipeline delayed — some reports may show stale data.'
           WHEN lvl0 = 'low' THEN 'Minor issue — limited impact, monitoring recommended.'
           ELSE 'Pipeline failure detected.' END
    END AS impact_desc
  FROM imp2b)"""


# The timeline and level texts below equal those of the detail views.
# ---- timelines -------------------------------------------------------------

_CAUSE_STEPS = """cause_steps(cat, k, tone, event) AS (VALUES
  ('OOM', 1, 'amber', 'Memory pressure rising — GC overhead building'),
  ('OOM', 2, 'red', 'GC limit exceeded — driver OOM · 0 rows written'),
  ('CLUSTER_FAILURE', 1, 'amber', 'Cluster health check failed'),
  ('CLUSTER_FAILURE', 2, 'red', 'Cluster terminated unexpectedly'),
  ('TIMEOUT', 1, 'amber', 'Upstream latency threshold crossed'),
  ('TIMEOUT', 2, 'amber', 'Pipeline delayed beyond SLA'),
  ('DATA_QUALITY', 1, 'amber', 'Schema validation triggered'),
  ('DATA_QUALITY', 2, 'red', 'AnalysisException — schema drift detected'),
  ('PERMISSION', 1, 'red', 'Access denied — credentials expired'),
  ('DEPENDENCY', 1, 'amber', 'Upstream dependency unavailable'),
  ('DEPENDENCY', 2, 'red', 'Pipeline blocked — dependency unresolved'),
  ('NETWORK', 1, 'amber', 'Network connectivity degraded'),
  ('NETWORK', 2, 'red', 'Connection timeout — pipeline aborted'),
  ('*', 1, 'red', 'Pipeline failed — see root cause'))"""

_KNOWN = "('OOM', 'CLUSTER_FAILURE', 'TIMEOUT', 'DATA_QUALITY', 'PERMISSION', 'DEPENDENCY', 'NETWORK')"


def _incident_timeline() -> str:
    return _inc(f"""SELECT incident_id, 1 AS seq, 'gray' AS tone, detected_at AS event_time,
  {minute('detected_at')} AS time_text, 'Pipeline run triggered on schedule' AS event FROM b
UNION ALL
SELECT b.incident_id, 1 + s.k, s.tone, b.detected_at, {minute('b.detected_at')}, s.event
FROM b JOIN cause_steps s ON s.cat = b.ckey
UNION ALL
SELECT incident_id, 2 + n2, 'amber', created_at, {minute('created_at')},
  'AI diagnosis job analysed and logged failure' FROM b
UNION ALL
SELECT incident_id, 3 + n2, CASE WHEN resolved_at IS NOT NULL THEN 'green' ELSE 'red' END,
  resolved_at, CASE WHEN resolved_at IS NOT NULL THEN {minute('resolved_at')} ELSE 'Ongoing' END,
  CASE WHEN resolved_at IS NULL THEN 'Awaiting SRE resolution'
       WHEN {auto_flag()} THEN 'Auto-resolved ✓' ELSE 'Manually resolved by SRE ✓' END FROM b""",
                _CAUSE_STEPS,
                f"""b AS (SELECT *, CASE WHEN upper(coalesce(cause_category, '')) IN {_KNOWN}
    THEN upper(cause_category) ELSE '*' END AS ckey,
  CASE WHEN upper(coalesce(cause_category, '')) IN {_KNOWN} AND upper(cause_category) <> 'PERMISSION'
    THEN 2 ELSE 1 END AS n2 FROM incidents)""")


def _metric_timeline() -> str:
    sev = "upper(coalesce(severity, ''))"
    kind = text("anomaly_type")
    tm = minute("timestamp")
    return _met(f"""SELECT insight_id, 1 AS seq, 'gray' AS tone, timestamp AS event_time, {tm} AS time_text,
  'Metric recorded: ' || {text('metric_value')} || ' ' || {text('metric_unit')} AS event FROM metric_insights
UNION ALL
SELECT insight_id, 2, CASE WHEN {sev} IN ('CRITICAL', 'HIGH') THEN 'red'
                           WHEN {sev} = 'MEDIUM' THEN 'amber' ELSE 'blue' END, timestamp, {tm},
  CASE WHEN {sev} IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN 'Anomaly detected — ' || {kind}
       ELSE 'Metric flagged — ' || {kind} END FROM metric_insights
UNION ALL
SELECT insight_id, 3, 'amber', timestamp, {tm}, 'AI diagnosis job analysed metric'
FROM metric_insights WHERE {sev} IN ('CRITICAL', 'HIGH', 'MEDIUM')
UNION ALL
SELECT insight_id, 4, 'red', timestamp, {tm}, {sev} || ' severity alert raised'
FROM metric_insights WHERE {sev} IN ('CRITICAL', 'HIGH')""")


# ---- assembled ---------------------------------------------------------------

def _share_sql(inner: str, key_cols: str, value: str) -> str:
    mx = f"max({value}) OVER ()"
    return (f"SELECT {key_cols}, CAST(trunc({value} / CASE WHEN {mx} IS NULL OR {mx} = 0 THEN 1 "
            f"ELSE {mx} END * 100) AS INTEGER) AS share FROM ({inner}) t")


def _label(x: str) -> str:
    spaced = f"lower(replace(coalesce({x}, ''), '_', ' '))"
    words = f"string_split(regexp_replace({spaced}, '([^\\p{{L}}])(\\p{{L}})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return (f"array_to_string(list_transform({words}, lambda w: upper(substring(w, 1, 1)) || "
            f"substring(w, 2)), '')")


def _filled(sql: str, columns: str) -> str:
    cols = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in columns.split(", "))
    return f"SELECT {cols} FROM ({sql}) filled_rows"


def build() -> dict[str, str]:
    ws_rollup = (
        "SELECT workspace_id, "
        f"{_cnt('resolved_at IS NULL')} AS \"open\", {_cnt('resolved_at IS NOT NULL')} AS resolved, "
        f"{_cnt(HIGH_OPEN)} AS crit FROM incidents WHERE {_w_inc(7)} GROUP BY workspace_id")
    value_text = strip(f"concat_ws(' ', {text('metric_value')}, {text('metric_unit')})")
    by_cat = (f"SELECT cause_category, COUNT(*) AS cnt FROM incidents WHERE {_w_inc(30)} "
              "GROUP BY cause_category ORDER BY cnt DESC, cause_category ASC NULLS FIRST LIMIT 8")
    m_by_cat = (f"SELECT metric_category, COUNT(*) AS cnt FROM metric_insights WHERE {_w_met(90)} "
                "GROUP BY metric_category ORDER BY cnt DESC, metric_category ASC NULLS FIRST LIMIT 10")
    m_by_sev = (f"SELECT upper(severity) AS severity, COUNT(*) AS cnt FROM metric_insights "
                f"WHERE {_w_met(90)} GROUP BY upper(severity)")
    by_team = ("SELECT team_name, ROUND(AVG(mttr_minutes) / 60, 1) AS hrs FROM incidents "
               f"WHERE mttr_minutes IS NOT NULL AND mttr_minutes > 0 AND {_w_inc(30)} "
               "GROUP BY team_name ORDER BY hrs DESC NULLS LAST, team_name ASC NULLS FIRST LIMIT 5")
    daily = (f"SELECT detected_date, COUNT(*) AS cnt FROM incidents WHERE {_w_inc(14)} "
             "GROUP BY detected_date")
    inc_level = f"CASE WHEN {strip('lower(business_impact)')} LIKE '{{%' THEN 'none' ELSE {strip('lower(business_impact)')} END"

    def page(count_sql: str, size: int, pg: int) -> str:
        return (f"SELECT total, page_size, pages, least({pg}, pages - 1) AS page, "
                f"least({pg}, pages - 1) * page_size + 1 AS lo, "
                f"least((least({pg}, pages - 1) + 1) * page_size, total) AS hi FROM ("
                f"SELECT cnt AS total, CAST({size} AS BIGINT) AS page_size, "
                f"greatest(CAST(1 AS BIGINT), CAST(ceil(cnt / {size}) AS BIGINT)) AS pages "
                f"FROM ({count_sql}) c) p")

    page_parts = {
        "incident_week_stats": (
            "SELECT COUNT(*) AS total, "
            f"{_cnt('resolved_at IS NULL')} AS open_count, {_cnt('auto_resolved = true')} AS auto_resolved, "
            f"COUNT(DISTINCT cause_category) AS unique_categories FROM incidents WHERE {_w_inc(30)}"),
        "overview_kpis": (
            f"SELECT {_cnt('resolved_at IS NULL')} AS active_issues, "
            f"{_cnt(FAILING_OPEN)} AS pipelines_failing, {_cnt(STRESS_OPEN)} AS clusters_stress, "
            "CAST(COALESCE(ROUND(AVG(CASE WHEN mttr_minutes > 0 THEN mttr_minutes END), 0), 0) "
            f"AS BIGINT) AS mttr_min, COUNT(*) AS total, {_cnt('auto_resolved = true')} AS auto_resolved "
            f"FROM incidents WHERE {_w_inc(30)}"),
        "failures_by_category": by_cat,
        "failures_daily": (f"SELECT detected_date, COUNT(*) AS cnt FROM incidents "
                           f"WHERE {_w_inc(14)} GROUP BY detected_date"),
        "mttr_by_team": by_team,
        "workspace_rollup": (
            "SELECT workspace_id, "
            f"{_cnt('resolved_at IS NULL')} AS \"open\", {_cnt('resolved_at IS NOT NULL')} AS resolved, "
            f"{_cnt(HIGH_OPEN)} AS crit FROM incidents WHERE {_w_inc(30)} GROUP BY workspace_id"),
    }
    insights_answers = "\nUNION ALL BY NAME\n".join(
        f"SELECT '{q}' AS question, * FROM ({body}) t{i}"
        for i, (q, body) in enumerate(page_parts.items()))
    met_sql = oracle.build()
    met_parts = ["metric_kpis", "metric_count", "metric_categories", "metrics_by_category",
                 "metrics_by_severity", "metrics_by_workspace"]
    metrics_page = "\nUNION ALL BY NAME\n".join(
        f"SELECT '{q}' AS question, * FROM ({_met_body(met_sql[q])}) t{i}"
        for i, q in enumerate(met_parts))
    return {
        "metrics_page_answers": _met(metrics_page),
        "insights_answers": _inc(insights_answers),
        "incident_daily_rollup": _inc(
            "SELECT CAST(detected_at AS DATE) AS day, detected_date, workspace_id, team_name, "
            f"cause_category, COUNT(*) AS n, {_cnt('resolved_at IS NULL')} AS n_open, "
            f"{_cnt(HIGH_OPEN)} AS n_open_high, {_cnt('auto_resolved = true')} AS n_auto, "
            "CAST(COALESCE(SUM(CASE WHEN mttr_minutes > 0 THEN mttr_minutes END), 0) AS BIGINT) "
            f"AS mttr_sum, {_cnt('mttr_minutes > 0')} AS mttr_n FROM incidents "
            "GROUP BY CAST(detected_at AS DATE), detected_date, workspace_id, team_name, "
            "cause_category"),
        "incidents_scan": _inc(f"SELECT {oracle.INC_COLS} FROM incidents"),
        "metrics_scan": _met(f"SELECT {oracle.MET_COLS} FROM metric_insights"),
        "incident_list_filled": _filled(met_sql["incident_list"], oracle.INC_COLS),
        "incident_page_filled": _filled(met_sql["incident_page"], oracle.INC_COLS),
        "recent_open_filled": _filled(met_sql["recent_open"], oracle.INC_COLS),
        "metric_page_filled": _filled(met_sql["metric_page"], oracle.MET_COLS),
        "clean_text_documents": f"SELECT doc_id, {clean('raw')} AS clean FROM (SELECT doc_id, {RAW_TEXT} AS raw FROM documents) r",
        "business_impact_documents": (
            f"WITH src AS (SELECT doc_id, lower(lang) AS level, {RAW_IMPACT} AS impact, "
            f"CASE WHEN doc_id % 3 = 0 THEN text END AS fix, {RAW_TEXT} AS cause FROM documents),\n"
            + impact_ctes("src") + "\nSELECT doc_id, impact_level, sla_at_risk, impact_severity, impact_desc FROM imp3"),
        **{f"{name}_all_time": met_sql[f"{name}_all_time"] for name in oracle.ALL_TIME},
        "incident_resolve_unmatched": _inc(
            "SELECT DISTINCT incident_id FROM lookup_ids "
            "WHERE incident_id NOT IN (SELECT incident_id FROM incidents)", lookup_cte()),
        "incident_status": _inc(f"SELECT incident_id, {status()} AS status FROM incidents"),
        "clean_text": _inc(f"SELECT incident_id, {clean('root_cause')} AS root_cause_text, "
                           f"{clean('suggested_fix')} AS suggested_fix_text FROM incidents"),
        "business_impact": _inc(
            "SELECT incident_id, impact_level, sla_at_risk, impact_severity, impact_desc FROM imp3",
            f"src AS (SELECT incident_id, {strip('lower(business_impact)')} AS level, "
            "business_impact AS impact, suggested_fix AS fix, root_cause AS cause FROM incidents)",
            impact_ctes("src")),
        "incident_display": _inc(
            f"SELECT incident_id, {text('job_name')} AS job_name, {status()} AS status, "
            f"substring({clean('root_cause')}, 1, 55) AS cause_short, "
            f"{minute('detected_at')} AS detected, "
            "CASE WHEN resolved_at IS NOT NULL THEN 'View' ELSE 'Investigate' END AS action "
            "FROM incidents"),
        "incident_detail": _inc(
            f"SELECT incident_id, {text('job_name')} AS job_name, {text('workspace_id')} AS workspace_id, "
            f"{text('team_name')} AS team_name, {status()} AS status, "
            "upper(coalesce(cause_category, '')) AS failure_type, "
            f"{conf_pct()} AS confidence_pct, {auto_flag()} AS auto_resolved_flag, "
            f"{mttr_text()} AS mttr_text, {minute('detected_at')} AS detected, "
            f"{minute('created_at')} AS created, {minute('resolved_at')} AS resolved, "
            f"{clean('root_cause')} AS root_cause_text, {clean('suggested_fix')} AS suggested_fix_text, "
            "CASE WHEN impact_level IN ('high', 'medium', 'low') THEN impact_level ELSE 'medium' END "
            "AS impact_level, sla_at_risk, impact_severity, impact_desc FROM imp3",
            f"src AS (SELECT *, {inc_level} AS level, business_impact AS impact, "
            "suggested_fix AS fix, root_cause AS cause FROM incidents)",
            impact_ctes("src")),
        "incident_timeline": _incident_timeline(),
        "metric_display": _met(
            f"SELECT insight_id, {text('metric_name')} AS metric_name, "
            f"{text('metric_category')} AS metric_category, "
            "upper(coalesce(severity, '')) AS severity, "
            f"CASE WHEN {value_text} = '' THEN '{DASH}' ELSE {value_text} END AS value_text, "
            f"{text('workspace_id')} AS workspace_id, {minute('timestamp')} AS detected "
            "FROM metric_insights"),
        "metric_detail": (
            f"WITH {metrics_cte()},\n"
            "src AS (SELECT *, CASE upper(coalesce(severity, '')) WHEN 'CRITICAL' THEN 'high' "
            "WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' "
            "ELSE 'medium' END AS level, business_impact AS impact, suggested_fix AS fix, "
            "'' AS cause FROM metric_insights),\n" + impact_ctes("src") + "\n"
            f"SELECT insight_id, {text('metric_name')} AS metric_name, "
            "upper(coalesce(severity, '')) AS severity, level AS impact_level, "
            f"{text('metric_value')} AS value_text, "
            "CASE WHEN coalesce(metric_unit, '') = '' THEN 'no unit' ELSE metric_unit END AS unit_text, "
            f"{text('anomaly_type')} AS anomaly_type, {text('metric_category')} AS metric_category, "
            "upper(coalesce(cause_category, '')) AS cause_category, "
            f"{text('workspace_id')} AS workspace_id, {text('cluster_name')} AS cluster_name, "
            f"{conf_pct()} AS confidence_pct, {clean('suggested_fix')} AS suggested_fix_text, "
            f"{minute('timestamp')} AS detected, sla_at_risk, impact_severity, "
            f"CASE WHEN impact_desc = '{DASH}' THEN 'Review metric anomaly and apply suggested fix.' "
            "ELSE impact_desc END AS impact_desc FROM imp3"),
        "metric_timeline": _metric_timeline(),
        "page_summary": _inc(page(
            f"SELECT COUNT(*) AS cnt FROM incidents WHERE {_w_inc(7)} AND resolved_at IS NULL", 20, 3)),
        "status_page_summaries": _inc(
            "SELECT 'Open only' AS status, * FROM (" + page(
                f"SELECT COUNT(*) AS cnt FROM incidents WHERE {_w_inc(30)} AND resolved_at IS NULL",
                20, 3) + ") a UNION ALL SELECT 'Resolved only' AS status, * FROM (" + page(
                f"SELECT COUNT(*) AS cnt FROM incidents WHERE {_w_inc(30)} "
                "AND resolved_at IS NOT NULL", 20, 1000) + ") b"),
        "metric_page_summary": _met(page(
            f"SELECT COUNT(*) AS cnt FROM metric_insights WHERE {_w_met(90)}", 50, 1000)),
        "category_share": _inc(_share_sql(
            by_cat, f"cause_category, {_label('upper(cause_category)')} AS label, cnt", "cnt")),
        "metric_category_share": _met(_share_sql(
            m_by_cat, "metric_category, substring(coalesce(metric_category, ''), 1, 18) AS label, cnt",
            "cnt")),
        "severity_share": _met(_share_sql(m_by_sev, f"severity, {_label('severity')} AS label, cnt",
                                          "cnt")),
        "team_mttr_share": _inc(
            f"SELECT team_name, hrs, CAST(trunc(hrs / CASE WHEN max(hrs) OVER () IS NULL OR "
            "max(hrs) OVER () = 0 THEN 1 ELSE max(hrs) OVER () END * 100) AS INTEGER) AS share, "
            f"coalesce(hrs = max(hrs) OVER (), false) AS is_max FROM ({by_team}) t"),
        "daily_trend": _inc(
            "SELECT detected_date, cnt, bar_height, is_latest, latest_cnt, avg_cnt, "
            "latest_cnt > avg_cnt AS above_avg FROM ("
            "SELECT detected_date, cnt, greatest(5, CAST(trunc(cnt / CASE WHEN max(cnt) OVER () = 0 "
            "THEN 1 ELSE max(cnt) OVER () END * 100) AS INTEGER)) AS bar_height, rn = 1 AS is_latest, "
            "max(CASE WHEN rn = 1 THEN cnt END) OVER () AS latest_cnt, "
            "round(sum(cnt) OVER () / count(*) OVER (), 1) AS avg_cnt, rn FROM ("
            "SELECT detected_date, cnt, row_number() OVER (ORDER BY detected_date DESC NULLS LAST) AS rn "
            f"FROM ({daily}) d) r) x WHERE rn <= 14"),
        "workspace_health": _inc(
            "SELECT workspace_id, \"open\", resolved, crit, CASE WHEN crit > 0 THEN 'Critical' "
            f"WHEN \"open\" > 0 THEN 'Degraded' ELSE 'Healthy' END AS health FROM ({ws_rollup}) w"),
        "workspace_health_summary": _inc(
            "SELECT COUNT(*) AS workspaces, "
            f"{_cnt(OPEN_IS_ZERO)} AS healthy, {_cnt(DEGRADED)} AS degraded, "
            f"{_cnt('crit > 0')} AS critical, "
            "CASE WHEN COUNT(*) > 0 THEN CAST(trunc(SUM(CASE WHEN \"open\" = 0 THEN 1 ELSE 0 END) "
            f"/ COUNT(*) * 100) AS INTEGER) ELSE 0 END AS healthy_pct FROM ({ws_rollup}) w"),
        "reliability_summary": (
            f"WITH {incidents_cte()},\n{metrics_cte()},\n"
            "i AS (SELECT COUNT(*) AS total, "
            f"{_cnt('resolved_at IS NULL')} AS active_issues, "
            "CAST(coalesce(round(avg(CASE WHEN mttr_minutes IS NOT NULL AND mttr_minutes > 0 "
            "THEN mttr_minutes END), 0), 0) AS BIGINT) AS avg_mttr_min, "
            f"{_cnt('auto_resolved = true')} AS auto_resolved FROM incidents WHERE {_w_inc(7)}),\n"
            f"m AS (SELECT COUNT(*) AS metric_anomalies, "
            f"{_cnt(SEV_HIGH)} AS metric_crit_high FROM metric_insights WHERE {_w_met(7)})\n"
            "SELECT total, avg_mttr_min, auto_resolved, CASE WHEN total > 0 THEN "
            "round(auto_resolved / total * 100, 1) ELSE 0.0 END AS auto_rate, metric_anomalies, "
            "metric_crit_high, active_issues, "
            "CAST(greatest(0, least(100, 100 - active_issues * 5)) AS BIGINT) AS score, "
            "CASE WHEN greatest(0, least(100, 100 - active_issues * 5)) >= 80 THEN 'good' "
            "WHEN greatest(0, least(100, 100 - active_issues * 5)) >= 50 THEN 'fair' ELSE 'poor' END "
            "AS band FROM i, m"),
    }
