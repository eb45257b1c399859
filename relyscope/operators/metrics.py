"""Metric-anomaly operators M1-M7.

Severity compares case-insensitively through ``upper(severity)``; category
compares exactly (R5). The two exact distinct counts of M1 plan as one
``Expand`` with a group id, deduplicated map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import all_of, is_all, since
from ..sources.schemas import METRIC_COLUMNS
from .incidents import count_if

# Severities counted as "high" in the workspace breakdown.
HIGH_SEVERITIES = ("HIGH", "CRITICAL")


def _sev() -> Column:
    return F.upper(F.col("severity"))


def metric_window(as_of, days: int) -> Column:
    return since("timestamp", as_of, days)


def _filtered(metrics: DataFrame, as_of, days, severity, category) -> DataFrame:
    conds = [metric_window(as_of, days)]
    if not is_all(severity):
        conds.append(_sev() == F.lit(str(severity).upper()))
    if not is_all(category):
        conds.append(F.col("metric_category") == F.lit(category))
    return metrics.where(all_of(conds))


def newest_first() -> list[Column]:
    return [F.col("timestamp").desc_nulls_last(), F.col("insight_id").asc_nulls_first()]


def metric_kpis(metrics: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """M1: totals per severity plus distinct workspaces and categories."""
    return metrics.where(metric_window(as_of, days)).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(_sev() == F.lit("HIGH")).alias("high_sev"),
        count_if(_sev() == F.lit("CRITICAL")).alias("critical_sev"),
        count_if(_sev() == F.lit("MEDIUM")).alias("medium_sev"),
        F.count_distinct("workspace_id").alias("workspaces"),
        F.count_distinct("metric_category").alias("categories"),
    )


def metric_page(metrics: DataFrame, as_of=None, days: int = 7, severity: str | None = "All",
                category: str | None = "All", page_size: int = 20, offset: int = 0) -> DataFrame:
    """M2: one page of anomalies, newest first, with optional filters."""
    return (_filtered(metrics, as_of, days, severity, category).select(*METRIC_COLUMNS)
            .orderBy(*newest_first()).offset(int(offset)).limit(int(page_size)))


def metric_page_after(metrics: DataFrame, after_timestamp, after_insight_id: str, as_of=None,
                      days: int = 7, severity: str | None = "All", category: str | None = "All",
                      page_size: int = 20) -> DataFrame:
    """Keyset variant of M2: the page after row ``(timestamp, insight_id)``."""
    ts = F.lit(after_timestamp).cast(metrics.schema["timestamp"].dataType)
    after = (F.col("timestamp") < ts) | (
        (F.col("timestamp") == ts) & (F.col("insight_id") > F.lit(after_insight_id)))
    return (_filtered(metrics, as_of, days, severity, category).where(after)
            .select(*METRIC_COLUMNS).orderBy(*newest_first()).limit(int(page_size)))


def metric_count(metrics: DataFrame, as_of=None, days: int = 7, severity: str | None = "All",
                 category: str | None = "All") -> DataFrame:
    """M3: row count for the same filters as M2."""
    return _filtered(metrics, as_of, days, severity, category).agg(
        F.count(F.lit(1)).alias("cnt"))


def metric_categories(metrics: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """M4: distinct non-empty categories in the window, sorted.

    The reference prepends ``All`` for its filter box; that is a caller's
    choice, so only the data list is returned.
    """
    c = F.col("metric_category")
    return (metrics.where(metric_window(as_of, days) & c.isNotNull() & (c != F.lit("")))
            .select("metric_category").distinct().orderBy("metric_category"))


def metrics_by_category(metrics: DataFrame, as_of=None, days: int = 7, limit: int = 10) -> DataFrame:
    """M5: anomalies per category, top ``limit`` (null category kept)."""
    return (metrics.where(metric_window(as_of, days))
            .groupBy("metric_category").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("metric_category").asc_nulls_first())
            .limit(int(limit)))


def severity_counts(metrics: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """M6 rows without the display order (input of the severity shares)."""
    return (metrics.where(metric_window(as_of, days))
            .groupBy(_sev().alias("severity")).agg(F.count(F.lit(1)).alias("cnt")))


def metrics_by_severity(metrics: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """M6: anomalies per upper-cased severity (bounded by distinct severities)."""
    return (severity_counts(metrics, as_of, days)
            .orderBy(F.col("cnt").desc(), F.col("severity").asc_nulls_first()))


def metrics_by_workspace(metrics: DataFrame, as_of=None, days: int = 7, limit: int = 8) -> DataFrame:
    """M7: anomalies and HIGH/CRITICAL anomalies per workspace, top ``limit``."""
    return (metrics.where(metric_window(as_of, days))
            .groupBy("workspace_id").agg(
                F.count(F.lit(1)).alias("cnt"),
                count_if(_sev().isin(*HIGH_SEVERITIES)).alias("high_cnt"))
            .orderBy(F.col("cnt").desc(), F.col("workspace_id").asc_nulls_first())
            .limit(int(limit)))


def metrics_page_answers(metrics: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """M1, M3 (no filters), M4, M5, M6 and M7 in one frame, tagged by ``question``;
    each part keeps its own pushed window and map-side aggregate."""
    from ..plans.rollup import side_by_side

    return side_by_side({
        "metric_kpis": metric_kpis(metrics, as_of, days),
        "metric_count": metric_count(metrics, as_of, days),
        "metric_categories": metric_categories(metrics, as_of, days),
        "metrics_by_category": metrics_by_category(metrics, as_of, days),
        "metrics_by_severity": metrics_by_severity(metrics, as_of, days),
        "metrics_by_workspace": metrics_by_workspace(metrics, as_of, days),
    })
