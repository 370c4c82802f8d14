"""Derived tables kept in the shared folder for as long as their sources don't change.

What searches and listings read again and again (items, the text index, packed
vectors) is written once for each version of its source tables; a changed
source gives a new version and so a new table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinery.session import scratch

_versions: dict[tuple[str, str, str], tuple[str, str]] = {}


def version(spark: SparkSession, directory: str, tables: list[str]) -> str:
    """Length, file count and time of change of the tables' files."""
    jvm, stamps = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
        fs = path.getFileSystem(conf)
        size = fs.getContentSummary(path)
        stamps.append(f"{name} {size.getLength()} {size.getFileCount()} {fs.getFileStatus(path).getModificationTime()}")
    return ", ".join(stamps)


def folder(spark: SparkSession, directory: str, label: str, tables: list[str], write: Callable[[str], object]) -> str:
    """The folder that ``write`` filled for the present version of ``tables``."""
    key = (spark.sparkContext.applicationId, directory, label)
    now = version(spark, directory, tables)
    known = _versions.get(key)
    if known is None or known[0] != now:
        path = scratch(spark, label)
        write(path)
        known = _versions[key] = (now, path)
    return known[1]


def table(spark: SparkSession, directory: str, label: str, tables: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` gives, written once for each version of ``tables``."""
    path = folder(spark, directory, label, tables, lambda p: build().write.mode("overwrite").parquet(p))
    return spark.read.parquet(path)
