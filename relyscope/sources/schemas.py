"""Column contracts for the two input tables.

The reference has no DDL; these types are inferred from how each column is used
(SURVEY section 1). Timestamps may be ``TIMESTAMP`` or ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INCIDENT_COLUMNS: tuple[str, ...] = (
    "incident_id", "workspace_id", "team_name", "job_name", "root_cause",
    "cause_category", "confidence", "suggested_fix", "business_impact",
    "auto_resolved", "mttr_minutes", "detected_at", "detected_date",
    "resolved_at", "created_at",
)

METRIC_COLUMNS: tuple[str, ...] = (
    "insight_id", "workspace_id", "cluster_name", "metric_category",
    "metric_name", "metric_value", "metric_unit", "severity", "anomaly_type",
    "suggested_fix", "business_impact", "cause_category", "confidence",
    "timestamp",
)

_TS = (T.TimestampType, T.TimestampNTZType)
_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
        T.DoubleType, T.DecimalType)
_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Accepted Spark types per column (a tuple of DataType classes).
INCIDENT_TYPES: dict[str, tuple[type, ...]] = {
    "incident_id": (T.StringType,), "workspace_id": (T.StringType,),
    "team_name": (T.StringType,), "job_name": (T.StringType,),
    "root_cause": (T.StringType,), "cause_category": (T.StringType,),
    "confidence": _NUM, "suggested_fix": (T.StringType,),
    "business_impact": (T.StringType,), "auto_resolved": (T.BooleanType,),
    "mttr_minutes": _INT, "detected_at": _TS, "detected_date": (T.DateType,),
    "resolved_at": _TS, "created_at": _TS,
}

METRIC_TYPES: dict[str, tuple[type, ...]] = {
    "insight_id": (T.StringType,), "workspace_id": (T.StringType,),
    "cluster_name": (T.StringType,), "metric_category": (T.StringType,),
    "metric_name": (T.StringType,), "metric_value": _NUM,
    "metric_unit": (T.StringType,), "severity": (T.StringType,),
    "anomaly_type": (T.StringType,), "suggested_fix": (T.StringType,),
    "business_impact": (T.StringType,), "cause_category": (T.StringType,),
    "confidence": _NUM, "timestamp": _TS,
}


def check_columns(df: DataFrame, types: dict[str, tuple[type, ...]], what: str) -> DataFrame:
    """Fail fast (driver side, schema only, no job) on a wrong input frame."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in types if c not in fields]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    wrong = [f"{c}: {fields[c].simpleString()}" for c, ok in types.items()
             if not isinstance(fields[c], ok)]
    if wrong:
        raise TypeError(f"{what}: unexpected column types {wrong}")
    return df


def check_incidents(df: DataFrame) -> DataFrame:
    return check_columns(df, INCIDENT_TYPES, "incidents")


def check_metrics(df: DataFrame) -> DataFrame:
    return check_columns(df, METRIC_TYPES, "metric_insights")
