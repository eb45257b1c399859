"""Batch resolution of incidents.

The reference runs ``UPDATE incidents SET resolved_at = current_timestamp()``
per id. Plain Parquet has no UPDATE, so the portable form is an overlay: the
latest requested time per id (one partial aggregate of the request batch),
left-joined onto the incidents and coalesced over the old value, written as a
new snapshot. The join is on the unique key (no skew: ids are unique on both
sides after the aggregate) and Spark chooses its kind by the sizes it knows. ``mttr_minutes`` and ``auto_resolved`` are left as they are, as in
the reference; an existing ``resolved_at`` is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import write_snapshot


def _now(dtype: T.DataType):
    # TIMESTAMP_NTZ columns take the session-local wall clock.
    return F.localtimestamp() if isinstance(dtype, T.TimestampNTZType) else F.current_timestamp()


def latest_requests(incidents: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row per requested id: the latest requested time (null time = now)."""
    ts_type = incidents.schema["resolved_at"].dataType
    t = (F.coalesce(F.col("resolved_at").cast(ts_type), _now(ts_type))
         if "resolved_at" in resolutions.columns else _now(ts_type))
    return resolutions.groupBy("incident_id").agg(F.max(t).alias("_new_resolved_at"))


def resolve_incidents(incidents: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The incidents table with the requested resolutions applied."""
    joined = incidents.join(latest_requests(incidents, resolutions), "incident_id", "left")
    cols = [F.coalesce(F.col("_new_resolved_at"), F.col("resolved_at")).alias("resolved_at")
            if c == "resolved_at" else F.col(c) for c in incidents.columns]
    return joined.select(*cols)


def unmatched_resolutions(incidents: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Requested ids that match no incident (the reference reports success anyway)."""
    wanted = resolutions.select("incident_id").distinct()
    return wanted.join(incidents.select("incident_id"), "incident_id", "left_anti")


def write_resolved_partitions(incidents: DataFrame, resolutions: DataFrame, path: str) -> str:
    """Write the ``detected_date`` partitions that hold a requested incident, resolved.

    ``path`` receives only those partitions (dynamic overwrite): a table kept
    as one snapshot path per partition swaps them in, and every other partition
    stays where it is. The path must not be the one ``incidents`` is read from.
    """
    latest = latest_requests(incidents, resolutions)
    touched = incidents.join(latest, "incident_id", "left_semi").select("detected_date").distinct()
    rows = incidents.join(touched, "detected_date", "left_semi").select(*incidents.columns)
    return write_snapshot(resolve_incidents(rows, resolutions), path, ("detected_date",), mode="overwrite")


def swap_resolved_partitions(incidents: DataFrame, resolutions: DataFrame, table: str, staging: str) -> str:
    """Resolve a batch inside the partitioned ``table`` that ``incidents`` is read from.

    The touched ``detected_date`` partitions are written to ``staging`` (a path of
    its own) and, once they are whole, put in place of the table's (dynamic overwrite
    replaces the partitions that hold rows and no others). A failure before the swap
    leaves the table as it was; one inside it can be mended by running the swap again,
    since ``staging`` is not touched by it. Returns the table's path.
    """
    spark = incidents.sparkSession
    write_resolved_partitions(incidents, resolutions, staging)
    swapped = spark.read.schema(incidents.schema).parquet(staging).select(*incidents.columns)
    write_snapshot(swapped, table, ("detected_date",), mode="overwrite")
    spark.catalog.refreshByPath(table)
    return table


def write_resolved_snapshot(incidents: DataFrame, resolutions: DataFrame, path: str,
                            partition_by: tuple[str, ...] = ("detected_date",)) -> str:
    """Write the whole resolved table to a new directory (never over its own input)."""
    return write_snapshot(resolve_incidents(incidents, resolutions), path, partition_by)
