"""Parquet tables addressed by directory and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory; nothing is read until an action needs its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
