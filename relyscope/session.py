"""Session settings for local runs and tests.

On a cluster the caller owns the session; these helpers only fill in what is
unset. Nothing here hard-codes a machine-local folder for cluster use: the
checkpoint folder is read from ``spark.checkpoint.dir`` and only set (to a
caller-given path) when the session has none, as in tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that matter for every plan in this library.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Local mode runs every task inside the driver JVM: give it real memory.
    "spark.driver.memory": "4g",
}


# Settings for a large cluster (pass to spark-submit or the session builder).
# AQE picks the post-shuffle partition count from the data (the initial
# count only has to be high enough for the largest shuffle); skewed shuffle partitions are split at runtime; file
# splits stay near one row group so scans spread over all executors.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.shuffle.partitions": "2000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "relyscope", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder named by the cluster, else ``fallback``.

    The fallback is applied only when the session has no folder configured
    (tests); a configured folder is never replaced.
    """
    configured = spark.sparkContext.getCheckpointDir() or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback:
        spark.sparkContext.setCheckpointDir(fallback)
        return spark.sparkContext.getCheckpointDir()
    return None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (``local[..]``, as in tests) sets a
    folder of its own; on a cluster there is no stand-in, and the error says so.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="relyscope-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables go; ``remove_run_folder`` clears it."""
    return f"{shared_folder(spark)}/relyscope/{spark.sparkContext.applicationId}"


def remove_run_folder(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
