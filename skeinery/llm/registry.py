"""Queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from importlib import import_module

MODULES = ["queries_text", "queries_stream", "queries_records", "queries_vectors"]


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found.update(import_module(f"skeinery.llm.{m}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found.update(import_module(f"skeinery.llm.{m}").ORACLE)
    return found
