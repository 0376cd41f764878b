"""Readers of the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt out to all tasks by `keys`: before work that is heavy for its bytes, as a small file, however many rows it has, is read by one or two tasks."""
    return rows.repartition(*keys)
