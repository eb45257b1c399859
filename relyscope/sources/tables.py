"""Scans (S1, S2) and snapshot sink.

Scans return the contract columns only, so every operator downstream starts
from a pruned projection; Catalyst pushes the operators' filters into the
Parquet reader (``PushedFilters``) and reads only the columns each one uses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_folder
from .schemas import INCIDENT_COLUMNS, METRIC_COLUMNS, check_incidents, check_metrics


def _scan(spark: SparkSession, source: str, fmt: str) -> DataFrame:
    # A bare name is a catalog table; anything with a slash or scheme a path.
    if "/" in source or ":" in source:
        return spark.read.format(fmt).load(source)
    return spark.table(source)


def read_incidents(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """Scan the incidents table (path or catalog name), schema-checked."""
    return check_incidents(_scan(spark, source, fmt)).select(*INCIDENT_COLUMNS)


def read_metrics(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """Scan the metric_insights table (path or catalog name), schema-checked."""
    return check_metrics(_scan(spark, source, fmt)).select(*METRIC_COLUMNS)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that a job writes."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = (),
                   mode: str = "errorifexists", files_per_value: int = 8) -> str:
    """Write a result or a new table snapshot as Parquet.

    Default mode refuses to overwrite: a snapshot must go to a new directory,
    never onto the path it was computed from (Spark would read and delete the
    same files). Partitioning by ``detected_date`` keeps later window scans
    prunable. Rows are dealt by the partition columns and a salt of
    ``files_per_value`` first, so a partition gets that many files and not one
    from every task, and a hot day is shared by as many tasks.
    """
    w = df
    if partition_by:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value))
        w = df.repartition(*partition_by, salt)
    w = w.write.mode(mode)
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
