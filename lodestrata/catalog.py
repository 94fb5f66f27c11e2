"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import derived, flows, frames, graph, ingest, lifecycle, machines, search, surface, texts, times

_MODULES = [frames, graph, lifecycle, machines, search, derived, texts, flows, ingest, surface, times]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}


def entry(spark: SparkSession, root: str) -> DataFrame:
    """The flagship: hybrid retrieval over the frames, balanced profile."""
    return queries()["hybrid_balanced"](spark, root)
