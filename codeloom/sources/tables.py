"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder; the path is only opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
