"""Queries on personal information in texts (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.pii import redact_texts
from lodestrata.tables import table

SOURCES = (("raw_archive", "id", "content"), ("memory_frames", "id", "content"), ("conversation_messages", "msg_id", "text"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    parts = [table(spark, root, t).select(F.lit(f"{t}.{c}").alias("src_field"), F.col(k).alias("row_id"), F.col(c).alias("text")) for t, k, c in SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    found = redact_texts(texts(spark, root), with_text=False).filter("n_items > 0")
    return found.select("src_field", "row_id", F.explode("types").alias("pii_type")).distinct()


def p4_redacted(spark: SparkSession, root: str) -> DataFrame:
    return redact_texts(texts(spark, root)).select("src_field", "row_id", "n_items", "text")


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
