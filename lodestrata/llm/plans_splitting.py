"""Queries on oversized frames and pieces (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.splitting import LIMIT, split_long
from lodestrata.tables import table


def oversized(spark: SparkSession, root: str) -> DataFrame:
    """The records above the limit in the form that the operator takes.

    A piece longer than the limit lies in a frame longer than the limit, so only
    such frames are joined.
    """
    long = table(spark, root, "memory_frames").filter(F.length("content") > LIMIT).select("id", "content")
    nothing = F.lit(None)
    frame = long.select(F.lit("memory_frames.content").alias("src_field"), F.col("id").alias("row_id"), F.col("content").alias("text"), nothing.cast("string").alias("content"), nothing.cast("long").alias("char_start"), nothing.cast("long").alias("char_end"))
    chunks = table(spark, root, "frame_chunks").filter(F.length("text") > LIMIT)
    chunk = chunks.join(long, F.col("frame_id") == F.col("id"), "left").select(F.lit("frame_chunks.text").alias("src_field"), F.col("chunk_id").alias("row_id"), "text", F.coalesce("content", F.lit("")).alias("content"), F.col("char_start").cast("long"), F.col("char_end").cast("long"))
    return frame.unionByName(chunk)


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_long(oversized(spark, root))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_pieces(spark, root).filter("piece = 1").select("src_field", "row_id")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {
    "p3_found": f"""SELECT 'memory_frames.content' AS src_field, id AS row_id FROM memory_frames WHERE length(content) > {LIMIT}
        UNION ALL SELECT 'frame_chunks.text', chunk_id FROM frame_chunks WHERE length(text) > {LIMIT}"""
}
