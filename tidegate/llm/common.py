"""Shared helpers of the operators and their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.sources.work import stage, unstage

__all__ = ["stage", "table", "unstage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
