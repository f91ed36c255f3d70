"""Parquet tables of a directory, read with column pruning left to the optimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``{directory}/{name}.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
