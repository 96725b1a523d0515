"""Parquet table access shared by the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path is left to Spark's own file systems."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
