"""Insights-page values D15-D19.

All of these run after a top-k or a small keyed aggregate, so the one
whole-result window they use (``Window.partitionBy()``) sees at most a few
dozen rows (top-k) or one row per workspace/severity. The reliability summary
reads both tables in a single aggregate over their union: no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import is_open, since
from ..functions.text import label
from .incidents import count_if

# Reliability score and bands.
SCORE_PER_OPEN = 5
GOOD_FROM, FAIR_FROM = 80, 50
# Daily bars, minimum bar height and number of bars.
MIN_BAR, TREND_BARS = 5, 14
TITLE_CUT = 18

def _all() -> Window:
    return Window.partitionBy()


def _share(value: str) -> Column:
    """``int(value / max(value) * 100)``; a zero or missing max divides by 1."""
    mx = F.max(value).over(_all())
    den = F.when(mx.isNull() | (mx == 0), F.lit(1)).otherwise(mx)
    return (F.col(value) / den * 100).cast("int")


def category_share(by_category: DataFrame) -> DataFrame:
    """D15 on I9 rows: label and bar share per cause category."""
    return by_category.select(
        "cause_category", label(F.upper("cause_category")).alias("label"), "cnt",
        _share("cnt").alias("share"))


def metric_category_share(by_category: DataFrame) -> DataFrame:
    """D15 on M5 rows."""
    return by_category.select(
        "metric_category",
        F.substring(F.coalesce(F.col("metric_category"), F.lit("")), 1, TITLE_CUT).alias("label"),
        "cnt", _share("cnt").alias("share"))


def severity_share(by_severity: DataFrame) -> DataFrame:
    """D15 on M6 rows (ordered or not; the result carries the display order)."""
    return by_severity.select(
        "severity", label("severity").alias("label"), "cnt", _share("cnt").alias("share")
    ).orderBy(F.col("cnt").desc(), F.col("severity").asc_nulls_first())


def team_mttr_share(by_team: DataFrame) -> DataFrame:
    """D15 on I11 rows, plus the slowest-team flag."""
    return by_team.select(
        "team_name", "hrs", _share("hrs").alias("share"),
        F.coalesce(F.col("hrs") == F.max("hrs").over(_all()), F.lit(False)).alias("is_max"))


def daily_trend(daily: DataFrame) -> DataFrame:
    """D16 on I10 rows (at most 15; ordered or not, see ``daily_counts``).

    ``latest`` is the last row in date order (nulls first, so the newest date,
    or the null-date row when it is the only one); ``avg_cnt`` is the mean
    over all rows, rounded to one decimal; bars are the last 14 rows.
    """
    newest = Window.orderBy(F.col("detected_date").desc_nulls_last())
    ranked = daily.select("detected_date", "cnt", F.row_number().over(newest).alias("_rn"))
    latest = F.max(F.when(F.col("_rn") == 1, F.col("cnt"))).over(_all())
    avg = F.round(F.sum("cnt").over(_all()) / F.count(F.lit(1)).over(_all()), 1)
    top = F.max("cnt").over(_all())
    height = F.greatest(
        F.lit(MIN_BAR),
        (F.col("cnt") / F.when(top == 0, F.lit(1)).otherwise(top) * 100).cast("int"))
    return (ranked.select(
        "detected_date", "cnt", height.alias("bar_height"),
        (F.col("_rn") == 1).alias("is_latest"),
        latest.alias("latest_cnt"), avg.alias("avg_cnt"), "_rn")
        .where(F.col("_rn") <= TREND_BARS)
        .select("*", (F.col("latest_cnt") > F.col("avg_cnt")).alias("above_avg"))
        .drop("_rn").orderBy(F.col("detected_date").asc_nulls_first()))


def workspace_health(rollup: DataFrame) -> DataFrame:
    """D17 on I12 rows: Critical / Degraded / Healthy."""
    return rollup.select(
        "workspace_id", "open", "resolved", "crit",
        F.when(F.col("crit") > 0, F.lit("Critical"))
         .when(F.col("open") > 0, F.lit("Degraded"))
         .otherwise(F.lit("Healthy")).alias("health"))


def workspace_health_summary(rollup: DataFrame) -> DataFrame:
    """D18 on I12 rows: state counts and the healthy percentage."""
    total = F.count(F.lit(1))
    healthy = count_if(F.col("open") == 0)
    return rollup.agg(
        total.alias("workspaces"),
        healthy.alias("healthy"),
        count_if((F.col("open") > 0) & (F.col("crit") == 0)).alias("degraded"),
        count_if(F.col("crit") > 0).alias("critical"),
        F.when(total > 0, (healthy / total * 100).cast("int")).otherwise(F.lit(0))
         .alias("healthy_pct"))


def reliability_summary(incidents: DataFrame, metrics: DataFrame, as_of=None, days: int = 7,
                        metrics_as_of=None) -> DataFrame:
    """The insights KPI row (I5 and M1 combined) in one aggregate.

    Both windowed tables are projected to a common narrow shape and unioned,
    then aggregated once (partial aggregation per task, one-row final). The
    metric window uses ``metrics_as_of`` when given (the reference uses one
    date for both).
    """
    m_as_of = as_of if metrics_as_of is None else metrics_as_of
    mttr = F.col("mttr_minutes")
    inc = incidents.where(since("detected_at", as_of, days)).select(
        F.lit(True).alias("_inc"), is_open().alias("_open"),
        F.when(mttr.isNotNull() & (mttr > 0), mttr.cast("double")).alias("_mttr"),
        (F.col("auto_resolved") == F.lit(True)).alias("_auto"),
        F.lit(None).cast("string").alias("_sev"))
    met = metrics.where(since("timestamp", m_as_of, days)).select(
        F.lit(False).alias("_inc"), F.lit(False).alias("_open"),
        F.lit(None).cast("double").alias("_mttr"), F.lit(False).alias("_auto"),
        F.upper("severity").alias("_sev"))
    agg = inc.unionByName(met).agg(
        count_if(F.col("_inc")).alias("total"),
        count_if(F.col("_open")).alias("active_issues"),
        F.coalesce(F.round(F.avg("_mttr"), 0), F.lit(0.0)).cast("bigint").alias("avg_mttr_min"),
        count_if(F.col("_auto")).alias("auto_resolved"),
        count_if(~F.col("_inc")).alias("metric_anomalies"),
        count_if(F.col("_sev").isin("HIGH", "CRITICAL")).alias("metric_crit_high"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("active_issues") * SCORE_PER_OPEN))
    return agg.select(
        "total", "avg_mttr_min", "auto_resolved",
        F.when(F.col("total") > 0, F.round(F.col("auto_resolved") / F.col("total") * 100, 1))
         .otherwise(F.lit(0.0)).alias("auto_rate"),
        "metric_anomalies", "metric_crit_high", "active_issues",
        score.cast("bigint").alias("score"),
        F.when(score >= GOOD_FROM, F.lit("good")).when(score >= FAIR_FROM, F.lit("fair"))
         .otherwise(F.lit("poor")).alias("band"))
