"""Helpers shared by the operators: words, shared-folder tables, samples."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_folder

# The word of the data contract: a run of characters other than ASCII white space.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


#: Spark's setting that removes the shuffle files of a query when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound of the bytes in an Arrow batch that goes to a Python worker, and ours. The
#: default bounds rows only: 10,000 whole texts, twice in the executor and in the worker.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def by_value(module: str) -> None:
    """Ship a module's task functions inside the job, so that executors need no
    copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def small_batches(spark: SparkSession) -> None:
    """From now on tables go to Python workers in batches of ``BATCH`` bytes at most (a row at
    least), in this session and so also in results that are computed later."""
    spark.conf.set(BATCH_BYTES, str(BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts lineage with committed files: a lost executor costs a task's re-run,
    never the table. Every call writes a path of its own; nothing is deleted before
    the result is read: ``session.remove_run_folder`` clears an application's tables.
    The shuffle files of the write go with its end; only the table stays. Arrow batches
    are small from the first call on.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of the whole text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text mod 4: fold 2 is held out of all training."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


HELD_OUT_FOLD = 2


def bounded_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About ``bound`` rows of ``df`` at most, chosen by a hash of ``keys``: the
    same rows on every run, spread evenly, no sort and no single-task limit."""
    n = df.count()
    if n <= bound:
        return df
    top = (1 << 30) * bound // n
    return df.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < top)
