"""Queries on the quality of documents (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.quality import text_quality
from lodestrata.tables import table


def p8_stats(spark: SparkSession, root: str) -> DataFrame:
    return text_quality(table(spark, root, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_stats(spark, root).filter(F.size("reasons") > 0).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_stats": p8_stats}
