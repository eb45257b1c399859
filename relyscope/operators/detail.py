"""Display, detail and timeline views D8-D13.

Every view is one projection over the whole input frame (narrow, no shuffle):
the per-row Python of the reference becomes column expressions. Timelines
expand each row into its events with ``posexplode`` over an array of structs; the
cause-specific steps come from a literal map keyed by category, so there is no
lookup join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derived import auto_flag, confidence_pct, incident_status, mttr_text
from ..functions.impact import SEVERITY_LEVEL, with_business_impact
from ..functions.text import DASH, minute_text, plain_number, with_clean_texts, with_plain_numbers, ws_strip

# List-row cut of the cleaned root cause, and row actions.
CAUSE_CUT = 55
ACTION_VIEW, ACTION_INVESTIGATE = "View", "Investigate"
LEVELS = ("high", "medium", "low")
METRIC_REVIEW = "Review metric anomaly and apply suggested fix."
NO_UNIT = "no unit"

# Incident timeline texts, in timeline order.
TL_TRIGGERED = ("gray", "Pipeline run triggered on schedule")
TL_CAUSE_STEPS = {
    "OOM": (("amber", "Memory pressure rising — GC overhead building"),
            ("red", "GC limit exceeded — driver OOM · 0 rows written")),
    "CLUSTER_FAILURE": (("amber", "Cluster health check failed"),
                        ("red", "Cluster terminated unexpectedly")),
    "TIMEOUT": (("amber", "Upstream latency threshold crossed"),
                ("amber", "Pipeline delayed beyond SLA")),
    "DATA_QUALITY": (("amber", "Schema validation triggered"),
                     ("red", "AnalysisException — schema drift detected")),
    "PERMISSION": (("red", "Access denied — credentials expired"),),
    "DEPENDENCY": (("amber", "Upstream dependency unavailable"),
                   ("red", "Pipeline blocked — dependency unresolved")),
    "NETWORK": (("amber", "Network connectivity degraded"),
                ("red", "Connection timeout — pipeline aborted")),
}
TL_OTHER_CAUSE = (("red", "Pipeline failed — see root cause"),)
TL_DIAGNOSED = ("amber", "AI diagnosis job analysed and logged failure")
TL_AUTO = ("green", "Auto-resolved ✓")
TL_MANUAL = ("green", "Manually resolved by SRE ✓")
TL_AWAITING = ("red", "Awaiting SRE resolution")
TL_ONGOING = "Ongoing"
# Metric timeline texts.
MTL_RECORDED = "Metric recorded: "
MTL_DETECTED = "Anomaly detected — "
MTL_ANALYSED = "AI diagnosis job analysed metric"
MTL_ALERT = " severity alert raised"
MTL_FLAGGED = "Metric flagged — "


def _up(c: str) -> Column:
    return F.upper(F.coalesce(F.col(c), F.lit("")))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


# ---- S3 --------------------------------------------------------------------

def filled_records(rows: DataFrame) -> DataFrame:
    """S3: list records as text with blanks for nulls, as the list replies show them."""
    shown = lambda f: plain_number(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string")
    return rows.select(*[F.coalesce(shown(f), F.lit("")).alias(f.name) for f in rows.schema])


# ---- D8, D9 ----------------------------------------------------------------

def incident_display(incidents: DataFrame) -> DataFrame:
    """List rows (pipeline, status, short cause, detected, action)."""
    resolved = F.col("resolved_at").isNotNull()
    return with_clean_texts(incidents, {"_cause": "root_cause"}).select(
        "incident_id",
        _text("job_name").alias("job_name"),
        incident_status().alias("status"),
        F.substring("_cause", 1, CAUSE_CUT).alias("cause_short"),
        minute_text("detected_at").alias("detected"),
        F.when(resolved, F.lit(ACTION_VIEW)).otherwise(F.lit(ACTION_INVESTIGATE)).alias("action"),
    )


def _incident_level_in(impact: Column) -> Column:
    # The reference passes the whole lower-cased impact text as the level; for
    # JSON we pass "none" so the JSON severity decides.
    t = ws_strip(F.lower(impact))
    return F.when(t.startswith("{"), F.lit("none")).otherwise(t)


def incident_detail(incidents: DataFrame) -> DataFrame:
    """One wide row per incident with every derived field of the detail page."""
    b = F.col("business_impact")
    texts = with_clean_texts(incidents, {"root_cause_text": "root_cause",
                                         "suggested_fix_text": "suggested_fix"})
    staged = with_business_impact(texts, _incident_level_in(b), b, F.col("suggested_fix_text"),
                                  F.col("root_cause_text"), cleaned=True)
    return staged.select(
        "incident_id", _text("job_name").alias("job_name"),
        _text("workspace_id").alias("workspace_id"), _text("team_name").alias("team_name"),
        incident_status().alias("status"),
        _up("cause_category").alias("failure_type"),
        confidence_pct().alias("confidence_pct"),
        auto_flag().alias("auto_resolved_flag"),
        mttr_text().alias("mttr_text"),
        minute_text("detected_at").alias("detected"),
        minute_text("created_at").alias("created"),
        minute_text("resolved_at").alias("resolved"),
        "root_cause_text", "suggested_fix_text",
        F.when(F.col("impact_level").isin(*LEVELS), F.col("impact_level"))
         .otherwise(F.lit("medium")).alias("impact_level"),
        "sla_at_risk", "impact_severity", "impact_desc",
    )


# ---- D10 -------------------------------------------------------------------

def _step(tone: str, ts: Column, text: Column | str, time_text: Column) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(tone).alias("tone"), ts.alias("event_time"), time_text.alias("time_text"), text.alias("event"))


def _cause_steps_map() -> Column:
    entries = []
    for cat, steps in TL_CAUSE_STEPS.items():
        entries += [F.lit(cat), F.array(*[F.struct(F.lit(t).alias("tone"), F.lit(e).alias("event"))
                                          for t, e in steps])]
    return F.create_map(*entries)


def incident_timeline(incidents: DataFrame) -> DataFrame:
    """Ordered events per incident ``(incident_id, seq, tone, event_time, time_text, event)``."""
    ts_type = incidents.schema["detected_at"].dataType
    # each time is formatted once a row, whatever the number of events that show it
    incidents = incidents.select("incident_id", _up("cause_category").alias("__cat"), auto_flag().alias("__auto"), "detected_at", *[
        F.col(c).cast(ts_type).alias(c) for c in ("created_at", "resolved_at")]).select("*", *[
            minute_text(c).alias(f"__{c}") for c in ("detected_at", "created_at", "resolved_at")])
    det, resolved_at = F.col("detected_at"), F.col("resolved_at")
    other = F.array(*[F.struct(F.lit(t).alias("tone"), F.lit(e).alias("event"))
                      for t, e in TL_OTHER_CAUSE])
    cause = F.coalesce(_cause_steps_map()[F.col("__cat")], other)
    cause_steps = F.transform(cause, lambda s: F.struct(
        s["tone"].alias("tone"), det.alias("event_time"), F.col("__detected_at").alias("time_text"), s["event"].alias("event")))
    closed = (F.when(F.col("__auto"), _step(TL_AUTO[0], resolved_at, TL_AUTO[1], F.col("__resolved_at")))
              .otherwise(_step(TL_MANUAL[0], resolved_at, TL_MANUAL[1], F.col("__resolved_at"))))
    waiting = _step(TL_AWAITING[0], F.lit(None).cast(ts_type), TL_AWAITING[1], F.lit(TL_ONGOING))
    last = F.when(resolved_at.isNotNull(), closed).otherwise(waiting)
    steps = F.concat(F.array(_step(TL_TRIGGERED[0], det, TL_TRIGGERED[1], F.col("__detected_at"))), cause_steps,
                     F.array(_step(TL_DIAGNOSED[0], F.col("created_at"), TL_DIAGNOSED[1], F.col("__created_at")), last))
    return (incidents.select("incident_id", F.posexplode(steps).alias("pos", "s"))
            .select("incident_id", (F.col("pos") + 1).alias("seq"), "s.tone", "s.event_time",
                    "s.time_text", "s.event"))


# ---- D11, D12, D13 -----------------------------------------------------------

def _with_value(metrics: DataFrame) -> DataFrame:
    # The number's text is a stage of its own: views use it more than once.
    return with_plain_numbers(metrics, {"__num": "metric_value"})


def metric_display(metrics: DataFrame) -> DataFrame:
    """List rows (metric, category, severity, value with unit, workspace, time)."""
    v = F.col("__v")
    staged = _with_value(metrics).select("*", ws_strip(F.concat_ws(" ", "__num", _text("metric_unit"))).alias("__v"))
    return staged.select(
        "insight_id", _text("metric_name").alias("metric_name"),
        _text("metric_category").alias("metric_category"),
        _up("severity").alias("severity"),
        F.when(v == F.lit(""), F.lit(DASH)).otherwise(v).alias("value_text"),
        _text("workspace_id").alias("workspace_id"),
        minute_text("timestamp").alias("detected"),
    )


def _severity_level(sev: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEVERITY_LEVEL.items() for x in kv])
    return F.coalesce(m[sev], F.lit("medium"))


def _with_severity(metrics: DataFrame) -> DataFrame:
    # Upper-case the severity once per row (case mapping is not free) and
    # derive the impact level from it in the same stage.
    return metrics.select("*", _up("severity").alias("__sev")).select(
        "*", _severity_level(F.col("__sev")).alias("__lvl"))


def metric_detail(metrics: DataFrame) -> DataFrame:
    """One wide row per anomaly with the detail page's derived fields."""
    metrics = _with_value(_with_severity(metrics))
    texts = with_clean_texts(metrics, {"suggested_fix_text": "suggested_fix"})
    staged = with_business_impact(texts, F.col("__lvl"), F.col("business_impact"),
                                  F.col("suggested_fix_text"), F.lit(DASH), cleaned=True)
    unit = F.coalesce(F.col("metric_unit"), F.lit(""))
    return staged.select(
        "insight_id", _text("metric_name").alias("metric_name"),
        F.col("__sev").alias("severity"), F.col("__lvl").alias("impact_level"),
        F.coalesce("__num", F.lit("")).alias("value_text"),
        F.when(unit == F.lit(""), F.lit(NO_UNIT)).otherwise(unit).alias("unit_text"),
        _text("anomaly_type").alias("anomaly_type"),
        _text("metric_category").alias("metric_category"),
        _up("cause_category").alias("cause_category"),
        _text("workspace_id").alias("workspace_id"), _text("cluster_name").alias("cluster_name"),
        confidence_pct().alias("confidence_pct"),
        "suggested_fix_text",
        minute_text("timestamp").alias("detected"),
        "sla_at_risk", "impact_severity",
        F.when(F.col("impact_desc") == F.lit(DASH), F.lit(METRIC_REVIEW))
         .otherwise(F.col("impact_desc")).alias("impact_desc"),
    )


def metric_timeline(metrics: DataFrame) -> DataFrame:
    """Events per anomaly, all at the anomaly's time."""
    recorded_text = F.concat(F.lit(MTL_RECORDED), F.coalesce("__num", F.lit("")), F.lit(" "), _text("metric_unit"))
    metrics = _with_value(metrics).select(
        "insight_id", "timestamp", _up("severity").alias("__sev"), _text("anomaly_type").alias("__kind"),
        recorded_text.alias("__recorded"), minute_text("timestamp").alias("__time"))
    sev, kind = F.col("__sev"), F.col("__kind")
    step = lambda tone, text: _step(tone, F.col("timestamp"), text, F.col("__time"))
    recorded = step("gray", F.col("__recorded"))
    high = F.array(recorded,
                   step("red", F.concat(F.lit(MTL_DETECTED), kind)),
                   step("amber", MTL_ANALYSED),
                   step("red", F.concat(sev, F.lit(MTL_ALERT))))
    medium = F.array(recorded,
                     step("amber", F.concat(F.lit(MTL_DETECTED), kind)),
                     step("amber", MTL_ANALYSED))
    other = F.array(recorded, step("blue", F.concat(F.lit(MTL_FLAGGED), kind)))
    steps = (F.when(sev.isin("CRITICAL", "HIGH"), high)
             .when(sev == F.lit("MEDIUM"), medium).otherwise(other))
    return (metrics.select("insight_id", F.posexplode(steps).alias("pos", "s"))
            .select("insight_id", (F.col("pos") + 1).alias("seq"), "s.tone", "s.event_time",
                    "s.time_text", "s.event"))
