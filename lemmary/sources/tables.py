"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table (file or folder) below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")
