"""Registry of the engine's own queries and of their SQL checks."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["queries_catalog", "queries_analytics", "queries_text", "queries_search", "queries_pipeline", "queries_streaming", "queries_sources"]


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found.update(import_module(f"skeinery.plans.{m}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found.update(import_module(f"skeinery.plans.{m}").ORACLE)
    return found


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    """Hybrid search: keyword and vector candidates, fused and boosted."""
    return queries()["hybrid_boosted"](spark, directory)
