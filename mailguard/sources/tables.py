"""Readers for the driver's Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Tables whose rows carry the heavy per-row work (text, HTML, vectors, facts).
FACT_TABLES = frozenset({"documents", "pages", "conversations", "events", "lineitem",
                         "orders", "embeddings"})


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    A scan has one task per file split; a single large file with one row
    group yields one task and serialises all per-row work after it.  When the
    scan already has as many splits as the cluster has cores (always the case
    on a large input) the frame is returned unchanged and no shuffle is added.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; projections and filters applied later reach the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if name in FACT_TABLES else df
