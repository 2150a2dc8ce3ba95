"""All registered queries of this package (those of ``llm`` register themselves)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("field_queries", "event_queries", "statistics_queries", "join_queries", "report_queries", "extra_queries", "model_queries", "attribution_queries", "table_queries")


def _each(name: str) -> dict:
    import importlib

    out: dict = {}
    for module in _MODULES:
        out |= getattr(importlib.import_module(f"isobar.plans.{module}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("ORACLE")
