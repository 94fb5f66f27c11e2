"""All queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import plans_history, plans_names, plans_pii, plans_quality, plans_splitting, plans_tokens

_MODULES = [plans_names, plans_splitting, plans_pii, plans_history, plans_tokens, plans_quality]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
