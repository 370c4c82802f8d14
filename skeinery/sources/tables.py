"""Parquet table source: one file or folder per table in a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; columns prune and filters push into the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of every non-blank line of a text file or folder."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
