"""Queries on the tokens of the corpus (problems 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.packing import pack
from lodestrata.llm.tokens import decode_ids, encode_texts
from lodestrata.tables import table


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_texts(table(spark, root, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Per document the characters that come back from its ids."""
    return decode_ids(p6_ids(spark, root), "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return pack(table(spark, root, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """How many containers are filled how far, in steps of 64 tokens."""
    per = p7_containers(spark, root).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return per.groupBy((F.floor(F.col("tokens") / 64) * 64).alias("tokens_from")).agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_containers": p7_containers, "p7_fill": p7_fill}
SQL = {"p6_roundtrip": "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars FROM documents"}
