"""Registered queries: one per operator of SURVEY section 2.

Each entry takes ``(spark, sf_dir)``, derives the two input tables from the
driver tables (``sources.fixtures``) and runs one operator over the whole
table with the fixture reporting dates. ``relyscope.oracle`` holds the DuckDB
twin of every entry under the same key and column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.derived import incident_status
from .functions.impact import OUTPUTS, with_business_impact
from .functions.text import with_clean_texts, ws_strip
from .operators import detail as D
from .operators import incidents as I
from .operators import insights as N
from .operators import metrics as M
from .operators import paging as P
from .operators import resolve as R
from .operators.detail import filled_records
from .plans import rollup as RU
from .sources.schemas import INCIDENT_COLUMNS, METRIC_COLUMNS, check_incidents, check_metrics
from .sources.tables import new_table_path, read_incidents, read_metrics, write_snapshot
from .sources.fixtures import (
    INCIDENTS_AS_OF, METRICS_AS_OF, RAW_IMPACT, RAW_TEXT, load_incidents, load_lookup_ids, load_metrics,
    resolutions_from_incidents,
)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
INC_DAYS = 7
INC_LONG_DAYS = 30
MET_DAYS = 90
ALL_DAYS = 3650


def _inc(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_incidents(spark, sf_dir), as_of=INCIDENTS_AS_OF, **kw)
    return run


def _met(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_metrics(spark, sf_dir), as_of=METRICS_AS_OF, **kw)
    return run


def _incident_list(team=None) -> Query:
    def run(spark, sf_dir):
        return I.incident_list(load_incidents(spark, sf_dir), team=team, limit=50)
    return run


def _incident_lookup(spark, sf_dir):
    return I.incident_lookup(load_incidents(spark, sf_dir), load_lookup_ids(spark, sf_dir))


def _over_inc(view) -> Query:
    return lambda spark, sf_dir: view(load_incidents(spark, sf_dir))


def _over_met(view) -> Query:
    return lambda spark, sf_dir: view(load_metrics(spark, sf_dir))


def _then(query: Query, view, **kw) -> Query:
    return lambda spark, sf_dir: view(query(spark, sf_dir), **kw)


def _resolve(spark, sf_dir):
    inc = load_incidents(spark, sf_dir)
    return R.resolve_incidents(inc, resolutions_from_incidents(inc))


def _resolve_unmatched(spark, sf_dir):
    return R.unmatched_resolutions(load_incidents(spark, sf_dir), load_lookup_ids(spark, sf_dir))


def _written_incidents(spark, sf_dir) -> str:
    """The incidents as a table partitioned by detected_date in the shared folder."""
    return write_snapshot(load_incidents(spark, sf_dir), new_table_path(spark, "incidents"), ("detected_date",))


def _incidents_table(spark, sf_dir):
    return read_incidents(spark, _written_incidents(spark, sf_dir))


def _metrics_table(spark, sf_dir):
    dated = load_metrics(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    return read_metrics(spark, write_snapshot(dated, new_table_path(spark, "metric_insights"), ("day",), files_per_value=1))


def _table_kpis(spark, sf_dir):
    return I.overview_kpis(_incidents_table(spark, sf_dir), as_of=INCIDENTS_AS_OF, days=INC_DAYS, date_partitioned=True)


def _resolved_partitions(spark, sf_dir):
    """Resolve a batch inside a partitioned table and read the table back."""
    table = _written_incidents(spark, sf_dir)
    inc = read_incidents(spark, table)
    R.swap_resolved_partitions(inc, resolutions_from_incidents(inc), table, new_table_path(spark, "resolved"))
    return read_incidents(spark, table)


def _status_view(inc):
    return inc.select("incident_id", incident_status().alias("status"))


def _clean_view(inc):
    return with_clean_texts(inc, {"root_cause_text": "root_cause",
                                  "suggested_fix_text": "suggested_fix"}).select(
        "incident_id", "root_cause_text", "suggested_fix_text")


def _impact_view(inc):
    # The reference's own call: the lower-cased impact text is the level.
    b = F.col("business_impact")
    staged = with_business_impact(inc, ws_strip(F.lower(b)), b, F.col("suggested_fix"),
                                  F.col("root_cause"))
    return staged.select("incident_id", *OUTPUTS)


def _reliability(spark, sf_dir):
    return N.reliability_summary(load_incidents(spark, sf_dir), load_metrics(spark, sf_dir),
                                 as_of=INCIDENTS_AS_OF, days=INC_DAYS,
                                 metrics_as_of=METRICS_AS_OF)


def _rollup(spark, sf_dir):
    return RU.incident_daily_rollup(load_incidents(spark, sf_dir))


def _from_rollup(fn, days: int) -> Query:
    """An answer over the rollup of its window (the bound reaches the scan)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rollup = RU.incident_daily_rollup(load_incidents(spark, sf_dir), INCIDENTS_AS_OF, days)
        return fn(rollup, as_of=INCIDENTS_AS_OF, days=days)
    return run


def _clean_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{RAW_TEXT} AS raw")
    return with_clean_texts(rows, {"clean": "raw"}).select("doc_id", "clean")


def _impact_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id", "lower(lang) AS level", f"{RAW_IMPACT} AS impact",
        "CASE WHEN doc_id % 3 = 0 THEN text END AS fix", f"{RAW_TEXT} AS cause")
    return with_business_impact(rows, F.col("level"), F.col("impact"), F.col("fix"), F.col("cause")).select(
        "doc_id", *OUTPUTS)


# Answers by another way (from the rollup, from written tables): same SQL as the direct operators.
ROLLUP_TWINS = {
    "incidents_table": "incidents_scan",
    "metrics_table": "metrics_scan",
    "overview_kpis_table": "overview_kpis",
    "incident_resolve_partitions": "incident_resolve",
    "incident_week_stats_from_rollup": "incident_week_stats",
    "overview_kpis_from_rollup": "overview_kpis",
    "failures_by_category_from_rollup": "failures_by_category",
    "failures_daily_from_rollup": "failures_daily",
    "mttr_by_team_from_rollup": "mttr_by_team",
    "workspace_rollup_from_rollup": "workspace_rollup",
}


def build() -> dict[str, Query]:
    q: dict[str, Query] = {
        # incidents
        "incident_list": _incident_list(),
        "incident_list_team": _incident_list("team-3"),
        "incident_lookup": _incident_lookup,
        "incident_week_stats": _inc(I.incident_week_stats, days=INC_DAYS),
        "overview_kpis": _inc(I.overview_kpis, days=INC_DAYS),
        "recent_open": _inc(I.recent_open, days=INC_DAYS, limit=5),
        "incident_page": _inc(I.incident_page, days=INC_DAYS, status="Open only",
                              page_size=20, offset=20),
        "incident_page_resolved": _inc(I.incident_page, days=INC_LONG_DAYS,
                                       status="Resolved only", page_size=50, offset=100),
        "incident_page_all": _inc(I.incident_page, days=INC_DAYS, status="All",
                                  page_size=10, offset=0),
        "incident_count": _inc(I.incident_count, days=INC_DAYS, status="Open only"),
        "incident_count_resolved": _inc(I.incident_count, days=INC_LONG_DAYS,
                                        status="Resolved only"),
        "failures_by_category": _inc(I.failures_by_category, days=INC_LONG_DAYS),
        "failures_daily": _inc(I.failures_daily),
        "mttr_by_team": _inc(I.mttr_by_team, days=INC_LONG_DAYS),
        "workspace_rollup": _inc(I.workspace_rollup, days=INC_DAYS),
        # metrics
        "metric_kpis": _met(M.metric_kpis, days=MET_DAYS),
        "metric_page": _met(M.metric_page, days=MET_DAYS, page_size=20, offset=20),
        "metric_page_filtered": _met(M.metric_page, days=MET_DAYS, severity="High",
                                     category="cat_3", page_size=10, offset=0),
        "metric_count": _met(M.metric_count, days=MET_DAYS),
        "metric_count_filtered": _met(M.metric_count, days=MET_DAYS, severity="High",
                                      category="cat_3"),
        "metric_categories": _met(M.metric_categories, days=MET_DAYS),
        "metrics_by_category": _met(M.metrics_by_category, days=MET_DAYS),
        "metrics_by_severity": _met(M.metrics_by_severity, days=MET_DAYS),
        "metrics_by_workspace": _met(M.metrics_by_workspace, days=MET_DAYS),
    }
    q.update({
        "incident_resolve": _resolve,
        "incident_resolve_unmatched": _resolve_unmatched,
        # derived values over whole tables
        "incident_status": _over_inc(_status_view),
        "clean_text": _over_inc(_clean_view),
        "business_impact": _over_inc(_impact_view),
        "incident_display": _over_inc(D.incident_display),
        "incident_detail": _over_inc(D.incident_detail),
        "incident_timeline": _over_inc(D.incident_timeline),
        "metric_display": _over_met(D.metric_display),
        "metric_detail": _over_met(D.metric_detail),
        "metric_timeline": _over_met(D.metric_timeline),
        "page_summary": _then(q["incident_count"], P.page_summary, page_size=20, page=3),
        "metric_page_summary": _then(q["metric_count"], P.page_summary, page_size=50, page=1000),
        "status_page_summaries": _inc(P.status_page_summaries, days=INC_LONG_DAYS, page_size=20,
                                      open_page=3, resolved_page=1000),
        "category_share": _then(q["failures_by_category"], N.category_share),
        "metric_category_share": _then(q["metrics_by_category"], N.metric_category_share),
        "severity_share": _then(_met(M.severity_counts, days=MET_DAYS), N.severity_share),
        "team_mttr_share": _then(q["mttr_by_team"], N.team_mttr_share),
        "daily_trend": _then(_inc(I.daily_counts), N.daily_trend),
        "workspace_health": _then(q["workspace_rollup"], N.workspace_health),
        "workspace_health_summary": _then(q["workspace_rollup"], N.workspace_health_summary),
        "reliability_summary": _reliability,
        # schema-checked scans, blank-filled records
        "incidents_scan": lambda spark, sf_dir: check_incidents(load_incidents(spark, sf_dir)).select(*INCIDENT_COLUMNS),
        "metrics_scan": lambda spark, sf_dir: check_metrics(load_metrics(spark, sf_dir)).select(*METRIC_COLUMNS),
        "incident_list_filled": _then(q["incident_list"], filled_records),
        "incident_page_filled": _then(q["incident_page"], filled_records),
        "recent_open_filled": _then(q["recent_open"], filled_records),
        "metric_page_filled": _then(q["metric_page"], filled_records),
        # real tables, partitioned by date in the shared folder: read, read by window, resolved in place
        "incidents_table": _incidents_table,
        "metrics_table": _metrics_table,
        "overview_kpis_table": _table_kpis,
        "incident_resolve_partitions": _resolved_partitions,
        # the text rules over whole documents
        "clean_text_documents": _clean_documents,
        "business_impact_documents": _impact_documents,
        # whole metric history
        "metric_kpis_all_time": _met(M.metric_kpis, days=ALL_DAYS),
        "metric_count_all_time": _met(M.metric_count, days=ALL_DAYS),
        "metrics_by_category_all_time": _met(M.metrics_by_category, days=ALL_DAYS),
        "metrics_by_severity_all_time": _met(M.metrics_by_severity, days=ALL_DAYS),
        "metrics_by_workspace_all_time": _met(M.metrics_by_workspace, days=ALL_DAYS),
        # shared daily rollup and the insights answers read from it
        "incident_daily_rollup": _rollup,
        "incident_week_stats_from_rollup": _from_rollup(RU.week_stats, days=INC_DAYS),
        "overview_kpis_from_rollup": _from_rollup(RU.overview_kpis, days=INC_DAYS),
        "failures_by_category_from_rollup": _from_rollup(RU.failures_by_category,
                                                         days=INC_LONG_DAYS),
        "failures_daily_from_rollup": _from_rollup(RU.failures_daily, days=RU.DAILY_DAYS),
        "mttr_by_team_from_rollup": _from_rollup(RU.mttr_by_team, days=INC_LONG_DAYS),
        "workspace_rollup_from_rollup": _from_rollup(RU.workspace_rollup, days=INC_DAYS),
        "metrics_page_answers": _met(M.metrics_page_answers, days=MET_DAYS),
        "insights_answers": lambda spark, sf_dir: RU.insights_answers(
            load_incidents(spark, sf_dir), as_of=INCIDENTS_AS_OF, days=INC_LONG_DAYS),
    })
    return q
