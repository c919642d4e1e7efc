"""Read the driver-provided parquet tables by name (column pruning and filter
pushdown happen at the scan, so callers select only what they use)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, spread_key: str | None = None) -> DataFrame:
    """Read one table. With ``spread_key``, a scan that yields fewer splits than the
    cluster's parallelism (a few large row groups) is hash-repartitioned on that key
    so row-level text work uses every core; scans with enough splits are left alone
    (no extra shuffle at scale)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if spread_key is not None:
        df = spread(df, spread_key)
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as is
        return df
    return df.repartition(target, key) if splits < target else df
