"""Spark session settings shared by tests, bench and the driver entry.

Everything here is plain Spark configuration: UTC session time (the
reference forces its database session to UTC), AQE for runtime
re-planning (partition coalescing, skew-join splitting, broadcast
conversion from measured sizes) and a shuffle-partition count derived from
the core count.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Joins are broadcast only when Spark itself measured the side under this
# size (static estimate or AQE runtime statistics); anything larger stays a
# shuffled join, so nothing unbounded is ever shipped to every executor.
BROADCAST_LIMIT = str(32 * 1024 * 1024)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the library relies on to an existing session."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.autoBroadcastJoinThreshold", BROADCAST_LIMIT)
    conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST_LIMIT)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``; only when it is unset on a local master
    (tests) a scratch folder is created and registered.  On a cluster it must be
    set: a machine-local folder there would be another one on every executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext; the conf is enough
        sc = None
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tipflow-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None:
        sc.setCheckpointDir(path)
    return path


def app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", "app")


def build(master: str | None = None, partitions: int | None = None,
          app: str = "tipflow") -> SparkSession:
    """Local or cluster session with the library's settings."""
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    master = master or f"local[{cores}]"
    partitions = partitions or max(cores, 8)
    builder = SparkSession.builder
    if master.startswith("local"):
        # local runs only: keep the session catalog's folder out of the working directory
        builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tipflow-wh-", dir="/tmp"))
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIPFLOW_DRIVER_MEM", "16g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
