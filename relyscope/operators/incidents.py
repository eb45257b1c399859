"""Incident operators I1, I2, I4-I12.

Each is a function ``DataFrame -> DataFrame`` over the whole incidents frame:
nothing is collected, the reporting date is a parameter, and every top-k or
page carries a final tie-break key (R10) so results are repeatable.

Plan shapes (checked with ``explain``): window and equality predicates reach
the Parquet scan as pushed filters; global aggregates are one partial
``HashAggregate`` per task plus a single-row final; keyed aggregates combine
map-side before a shuffle of at most (tasks x groups) rows, so a hot key never
lands whole in one task; top-k and pages plan as ``TakeOrderedAndProject``
(each task keeps ``offset+limit`` rows, no full sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import (
    all_of, incident_window, is_all, is_open, is_resolved, status_filter,
)
from ..sources.schemas import INCIDENT_COLUMNS

# Cause categories counted by the overview KPIs.
FAILING_CATEGORIES = ("OOM", "CLUSTER_FAILURE")
STRESS_CATEGORY = "CLUSTER_FAILURE"
# The daily series always spans 14 days.
DAILY_DAYS = 14


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` filled with 0 (R6), BIGINT."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def newest_first() -> list[Column]:
    return [F.col("detected_at").desc_nulls_last(), F.col("incident_id").asc_nulls_first()]


def _positive_mttr() -> Column:
    return F.col("mttr_minutes").isNotNull() & (F.col("mttr_minutes") > 0)


# ---- I1 ------------------------------------------------------------------

def incident_list(incidents: DataFrame, team: str | None = None, limit: int = 50) -> DataFrame:
    """Newest incidents, optionally of one team (app list endpoint)."""
    cond = None if is_all(team) else (F.col("team_name") == F.lit(team))
    return incidents.where(all_of([cond])).orderBy(*newest_first()).limit(int(limit))


# ---- I2 ------------------------------------------------------------------

def incident_lookup(incidents: DataFrame, ids) -> DataFrame:
    """One answer row per requested id, with a ``found`` flag.

    ``ids`` is a frame with an ``incident_id`` column (or a list of strings);
    unknown ids come out with ``found = false``. If an id occurs more than
    once in the table, its newest row answers (ties: the largest row).

    The request is a semi join on the incidents, so rows that nobody asked for
    leave the plan first; the matched rows then meet the ids. No side is
    hinted or counted: Spark chooses by the sizes it knows.
    """
    spark = incidents.sparkSession
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(str(i),) for i in ids], "incident_id string")
    wanted = ids.select("incident_id").distinct()
    rest = [c for c in incidents.columns if c != "incident_id"]
    newest = F.max(F.struct("detected_at", *[c for c in rest if c != "detected_at"])).alias("_row")
    matched = incidents.join(wanted, "incident_id", "left_semi").groupBy("incident_id").agg(newest)
    return wanted.join(matched, "incident_id", "left").select(
        "incident_id", F.col("_row").isNotNull().alias("found"), *[F.col(f"_row.{c}").alias(c) for c in rest])


# ---- I4 ------------------------------------------------------------------

def incident_week_stats(incidents: DataFrame, as_of=None, days: int = 7,
                        date_partitioned: bool = False) -> DataFrame:
    """I4: total, open, auto-resolved, distinct categories (app /stats)."""
    return incidents.where(incident_window(as_of, days, date_partitioned)).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(is_open()).alias("open_count"),
        count_if(F.col("auto_resolved") == F.lit(True)).alias("auto_resolved"),
        F.count_distinct("cause_category").alias("unique_categories"),
    )


# ---- I5 ------------------------------------------------------------------

def overview_kpis(incidents: DataFrame, as_of=None, days: int = 7,
                  date_partitioned: bool = False) -> DataFrame:
    """The overview KPI row; all values BIGINT, missing -> 0."""
    cat = F.col("cause_category")
    mttr = F.avg(F.when(_positive_mttr(), F.col("mttr_minutes")))
    return incidents.where(incident_window(as_of, days, date_partitioned)).agg(
        count_if(is_open()).alias("active_issues"),
        count_if(cat.isin(*FAILING_CATEGORIES) & is_open()).alias("pipelines_failing"),
        count_if((cat == F.lit(STRESS_CATEGORY)) & is_open()).alias("clusters_stress"),
        F.coalesce(F.round(mttr, 0), F.lit(0.0)).cast("bigint").alias("mttr_min"),
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("auto_resolved") == F.lit(True)).alias("auto_resolved"),
    )


# ---- I6, I7, I8 ----------------------------------------------------------

def recent_open(incidents: DataFrame, as_of=None, days: int = 7, limit: int = 5,
                date_partitioned: bool = False) -> DataFrame:
    """Newest open incidents in the window (overview table)."""
    return (incidents.where(incident_window(as_of, days, date_partitioned) & is_open())
            .select(*INCIDENT_COLUMNS).orderBy(*newest_first()).limit(int(limit)))


def _status_rows(incidents, as_of, days, status, date_partitioned):
    return incidents.where(all_of([incident_window(as_of, days, date_partitioned),
                                   status_filter(status)]))


def incident_page(incidents: DataFrame, as_of=None, days: int = 7, status: str = "Open only",
                  page_size: int = 20, offset: int = 0,
                  date_partitioned: bool = False) -> DataFrame:
    """One page by status; plans as ``TakeOrderedAndProject(offset+size, offset)``.

    For deep pages prefer :func:`incident_page_after` (keyset), whose per-task
    state does not grow with the page number.
    """
    return (_status_rows(incidents, as_of, days, status, date_partitioned)
            .select(*INCIDENT_COLUMNS).orderBy(*newest_first())
            .offset(int(offset)).limit(int(page_size)))


def incident_page_after(incidents: DataFrame, after_detected_at, after_incident_id: str,
                        as_of=None, days: int = 7, status: str = "Open only",
                        page_size: int = 20, date_partitioned: bool = False) -> DataFrame:
    """Keyset variant of I7: the page that follows row ``(detected_at, id)``.

    Same order as :func:`incident_page`; rows strictly after the given key in
    that order. The bound is a plain predicate, so it is pushed to the scan.
    """
    ts = F.lit(after_detected_at).cast(incidents.schema["detected_at"].dataType)
    after = (F.col("detected_at") < ts) | (
        (F.col("detected_at") == ts) & (F.col("incident_id") > F.lit(after_incident_id)))
    return (_status_rows(incidents, as_of, days, status, date_partitioned).where(after)
            .select(*INCIDENT_COLUMNS).orderBy(*newest_first()).limit(int(page_size)))


def incident_count(incidents: DataFrame, as_of=None, days: int = 7, status: str = "Open only",
                   date_partitioned: bool = False) -> DataFrame:
    """I8: row count for the same filter as I7."""
    return _status_rows(incidents, as_of, days, status, date_partitioned).agg(
        F.count(F.lit(1)).alias("cnt"))


# ---- I9 - I12 (insights page) --------------------------------------------

def failures_by_category(incidents: DataFrame, as_of=None, days: int = 7, limit: int = 8,
                         date_partitioned: bool = False) -> DataFrame:
    """Incidents per cause category, top ``limit`` (null category kept, R8)."""
    return (incidents.where(incident_window(as_of, days, date_partitioned))
            .groupBy("cause_category").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("cause_category").asc_nulls_first())
            .limit(int(limit)))


def daily_counts(incidents: DataFrame, as_of=None, days: int = DAILY_DAYS,
                 date_partitioned: bool = False) -> DataFrame:
    """I10 rows without the display order (input of the daily trend, D16)."""
    return (incidents.where(incident_window(as_of, days, date_partitioned))
            .groupBy("detected_date").agg(F.count(F.lit(1)).alias("cnt")))


def failures_daily(incidents: DataFrame, as_of=None, days: int = DAILY_DAYS,
                   date_partitioned: bool = False) -> DataFrame:
    """Incidents per ``detected_date`` over the fixed 14-day window."""
    return (daily_counts(incidents, as_of, days, date_partitioned)
            .orderBy(F.col("detected_date").asc_nulls_first()))


def mttr_by_team(incidents: DataFrame, as_of=None, days: int = 7, limit: int = 5,
                 date_partitioned: bool = False) -> DataFrame:
    """Mean positive MTTR per team in hours, one decimal, top ``limit``."""
    return (incidents.where(_positive_mttr() & incident_window(as_of, days, date_partitioned))
            .groupBy("team_name")
            .agg(F.round(F.avg("mttr_minutes") / 60, 1).alias("hrs"))
            .orderBy(F.col("hrs").desc_nulls_last(), F.col("team_name").asc_nulls_first())
            .limit(int(limit)))


def workspace_rollup(incidents: DataFrame, as_of=None, days: int = 7,
                     date_partitioned: bool = False) -> DataFrame:
    """Open / resolved / critical-open per workspace, most open first.

    Unbounded by design (every workspace); its size is the number of
    workspaces, not of incidents.
    """
    return (incidents.where(incident_window(as_of, days, date_partitioned))
            .groupBy("workspace_id").agg(
                count_if(is_open()).alias("open"),
                count_if(is_resolved()).alias("resolved"),
                count_if((F.col("business_impact") == F.lit("high")) & is_open()).alias("crit"))
            .orderBy(F.col("open").desc(), F.col("workspace_id").asc_nulls_first()))
