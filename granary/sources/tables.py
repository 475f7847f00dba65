"""Parquet tables of a data directory as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; the path may be of any file system Spark knows."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
