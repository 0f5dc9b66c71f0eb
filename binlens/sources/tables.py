"""Driver tables (one parquet file each) as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str, balanced: bool = True) -> DataFrame:
    """A driver table. ``balanced``: spread a scan of fewer splits than cores (a small
    single-row-group file); the scan knows its splits without running a job, and a large
    input is read as it is split."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(table_path(sf_dir, name))
    cores = spark.sparkContext.defaultParallelism
    if balanced and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def table_view_name(sf_dir: str, name: str) -> str:
    """Session temp-view name of a (balanced) driver table of one scale directory."""
    import hashlib
    return f"_bl_{hashlib.md5(os.path.abspath(sf_dir).encode()).hexdigest()[:10]}_{name}"


def register_tables(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Register every driver table of ``sf_dir`` as a temp view; returns name -> view name."""
    out = {}
    for t in TABLES:
        v = table_view_name(sf_dir, t)
        if not spark.catalog.tableExists(v):
            table(spark, sf_dir, t).createOrReplaceTempView(v)
        out[t] = v
    return out
