"""Loading of the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
