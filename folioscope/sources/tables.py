"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """The named table, cut to ``columns`` (the scan then reads only these)."""
    frame = spark.read.parquet(f"{directory}/{name}.parquet")
    return frame.select(*columns) if columns else frame
