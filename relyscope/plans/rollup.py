"""Shared daily rollup.

The insights page asks six questions of ``incidents`` (I4, I5, I9, I10, I11,
I12); the reference scans the table once per question. Here one aggregate by
``(day, detected_date, workspace_id, team_name, cause_category)`` keeps the
counts every one of them needs, and each answer is a small second aggregate
over the days of its window. The rollup's size is days x groups, independent of
the number of incidents, and it is built with partial aggregation, so a hot
workspace or category never concentrates raw rows in one task.

Exactness: the R1 window cuts at midnight, so ``detected_at >= as_of - n``
is the same as ``day >= as_of - n`` with ``day = to_date(detected_at)``;
MTTR is an integer, so ``sum / count`` of the positive minutes reproduces
``avg`` exactly.

``write_rollup`` stores it partitioned by ``day``; every answer filters ``day``
first, so over a stored rollup it reads the partitions of its window only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import incident_window, is_open, window_start
from ..operators import incidents as I
from ..operators.incidents import DAILY_DAYS, FAILING_CATEGORIES, STRESS_CATEGORY, count_if

ROLLUP_KEYS = ("day", "detected_date", "workspace_id", "team_name", "cause_category")
MEASURES = ("n", "n_open", "n_open_high", "n_auto", "mttr_sum", "mttr_n")


def incident_daily_rollup(incidents: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """One row per (day, detected_date, workspace, team, category) with counts.

    ``days`` limits the rollup to the window before ``as_of``; the bound is a
    plain predicate on ``detected_at`` and reaches the scan.
    """
    src = incidents if days is None else incidents.where(incident_window(as_of, days))
    mttr = F.col("mttr_minutes")
    positive = mttr.isNotNull() & (mttr > 0)
    return src.groupBy(F.to_date("detected_at").alias("day"), "detected_date", "workspace_id",
                       "team_name", "cause_category").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(is_open()).alias("n_open"),
        count_if(is_open() & (F.col("business_impact") == F.lit("high"))).alias("n_open_high"),
        count_if(F.col("auto_resolved") == F.lit(True)).alias("n_auto"),
        F.coalesce(F.sum(F.when(positive, mttr.cast("bigint"))), F.lit(0)).alias("mttr_sum"),
        count_if(positive).alias("mttr_n"),
    )


def _window(rollup: DataFrame, as_of, days: int) -> DataFrame:
    return rollup.where(F.col("day") >= window_start(as_of, days))


def _total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _mean(sum_col: Column, n_col: Column) -> Column:
    return F.when(n_col > 0, sum_col.cast("double") / n_col)


def week_stats(rollup: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """I4 from the rollup."""
    return _window(rollup, as_of, days).agg(
        _total("n").alias("total"), _total("n_open").alias("open_count"), _total("n_auto").alias("auto_resolved"),
        F.count_distinct("cause_category").alias("unique_categories"))


def overview_kpis(rollup: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """I5 from the rollup."""
    cat = F.col("cause_category")
    return _window(rollup, as_of, days).agg(
        _total("n_open").alias("active_issues"),
        _total(F.when(cat.isin(*FAILING_CATEGORIES), F.col("n_open"))).alias("pipelines_failing"),
        _total(F.when(cat == F.lit(STRESS_CATEGORY), F.col("n_open"))).alias("clusters_stress"),
        F.coalesce(F.round(_mean(_total("mttr_sum"), _total("mttr_n")), 0), F.lit(0.0)).cast("bigint").alias("mttr_min"),
        _total("n").alias("total"), _total("n_auto").alias("auto_resolved"))


def failures_by_category(rollup: DataFrame, as_of=None, days: int = 7, limit: int = 8) -> DataFrame:
    """I9 from the rollup."""
    return (_window(rollup, as_of, days).groupBy("cause_category").agg(_total("n").alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("cause_category").asc_nulls_first())
            .limit(int(limit)))


def failures_daily(rollup: DataFrame, as_of=None, days: int = DAILY_DAYS) -> DataFrame:
    """I10 from the rollup (window on the detection day, groups on detected_date)."""
    return (_window(rollup, as_of, days).groupBy("detected_date").agg(_total("n").alias("cnt"))
            .orderBy(F.col("detected_date").asc_nulls_first()))


def mttr_by_team(rollup: DataFrame, as_of=None, days: int = 7, limit: int = 5) -> DataFrame:
    """I11 from the rollup; teams without a positive MTTR drop out, as in I11."""
    return (_window(rollup, as_of, days).groupBy("team_name").agg(
                _total("mttr_sum").alias("_s"), _total("mttr_n").alias("_n"))
            .where(F.col("_n") > 0)
            .select("team_name", F.round(_mean(F.col("_s"), F.col("_n")) / 60, 1).alias("hrs"))
            .orderBy(F.col("hrs").desc_nulls_last(), F.col("team_name").asc_nulls_first())
            .limit(int(limit)))


def workspace_rollup(rollup: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """I12 from the rollup."""
    return (_window(rollup, as_of, days).groupBy("workspace_id").agg(
                _total("n").alias("_n"), _total("n_open").alias("open"), _total("n_open_high").alias("crit"))
            .select("workspace_id", "open", (F.col("_n") - F.col("open")).alias("resolved"), "crit")
            .orderBy(F.col("open").desc(), F.col("workspace_id").asc_nulls_first()))


def insights_answers(incidents: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """All six incident questions of the insights page in one frame.

    The direct operators side by side, each row tagged with its question; a
    column that a question does not use is null. Each part keeps its own pushed
    window, map-side aggregate and top-k, and no part ranks or counts all groups
    in one task.
    """
    parts = {
        "incident_week_stats": I.incident_week_stats(incidents, as_of, days),
        "overview_kpis": I.overview_kpis(incidents, as_of, days),
        "failures_by_category": I.failures_by_category(incidents, as_of, days),
        "failures_daily": I.failures_daily(incidents, as_of),
        "mttr_by_team": I.mttr_by_team(incidents, as_of, days),
        "workspace_rollup": I.workspace_rollup(incidents, as_of, days),
    }
    return side_by_side(parts)


def side_by_side(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts' rows with a ``question`` column, by column name."""
    frames = [df.select(F.lit(name).alias("question"), "*") for name, df in parts.items()]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole


def write_rollup(rollup: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Store the rollup, partitioned by ``day``, one file a day (a day's rollup rows
    number workspaces x teams x categories)."""
    rollup.repartition("day").write.mode(mode).partitionBy("day").parquet(path)
    return path
