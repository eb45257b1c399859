"""Gapless numbers per key, without gathering a key in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, stored

by_value(__name__)


def numbered_batches(batches, key: str):
    """Adds ``part`` (the task's partition) and ``local`` (0, 1, ... per key in it)."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        values, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        local = np.empty(len(keys), np.int64)
        first = np.repeat(np.cumsum(n) - n, n)
        local[np.argsort(at, kind="stable")] = np.arange(len(keys)) - first
        base = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
        seen.update(zip(values.tolist(), (base + n).tolist()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(keys), part)), pa.array(local + base[at])],
            [*batch.schema.names, "part", "local"])


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... over the rows of each value of ``key`` (an
    integer column of few values). One pass numbers rows inside its partitions and
    writes them; counts per (key, partition) then shift each partition's numbers."""
    fields = [f for f in df.schema.fields] + [T.StructField("part", T.LongType()), T.StructField("local", T.LongType())]
    rows = stored(df.mapInArrow(lambda it: numbered_batches(it, key), T.StructType(fields)), "numbered")
    ahead = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(key, "part").agg(F.count("*").alias("n")).select(
        key, "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return rows.join(shift, [key, "part"]).withColumn(name, F.col("local") + F.col("ahead")).select(*df.columns, name)
