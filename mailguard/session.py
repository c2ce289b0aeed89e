"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mailguard", conf: dict | None = None) -> SparkSession:
    """Session tuned for the library's jobs.

    The master, the driver's memory and the partition counts come from the
    submit configuration unless they are passed or set in ``MAILGUARD_MASTER``
    and ``MAILGUARD_DRIVER_MEMORY``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs several JVM round trips per Column call.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Parsing jobs hand Arrow batches to Python; keep them small so a
        # batch of large messages fits comfortably in worker memory.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    )
    if master := master or os.environ.get("MAILGUARD_MASTER"):
        builder = builder.master(master)
    if memory := os.environ.get("MAILGUARD_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", memory)
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` when set.  Where it is unset, a
    local master (tests) gets a fresh scratch folder; a cluster, whose machines
    do not share one, gets an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        current = tempfile.mkdtemp(prefix="mailguard-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
