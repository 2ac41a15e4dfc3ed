"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``; columns and filters are pruned at the scan by what uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
