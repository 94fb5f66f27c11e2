"""Queries on written times (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.timestamps import PLAIN, normalize_times
from lodestrata.tables import table


def written_times(spark: SparkSession, root: str) -> DataFrame:
    """src_field, row_key, value and source of all three time columns."""
    archive = table(spark, root, "raw_archive").select(F.lit("raw_archive.source_timestamp").alias("src_field"), F.col("id").cast("string").alias("row_key"), F.col("source_timestamp").alias("value"), "source")
    items = table(spark, root, "import_items")
    item = items.select(F.lit("import_items.item_timestamp").alias("src_field"), F.col("item_id").alias("row_key"), F.col("item_timestamp").alias("value"), "source")
    messages = table(spark, root, "conversation_messages").filter("msg_timestamp IS NOT NULL").select("msg_id", "item_id", F.col("msg_timestamp").alias("value"))
    message = messages.join(items.select("item_id", "source"), "item_id", "left").select(F.lit("conversation_messages.msg_timestamp").alias("src_field"), F.col("msg_id").cast("string").alias("row_key"), "value", "source")
    return archive.unionByName(item).unionByName(message)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    values = written_times(spark, root).filter(F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN))
    resolved = normalize_times(values, table(spark, root, "harvest_sources")).filter("status = 'resolved'")
    return resolved.select("src_field", "row_key", "utc_us").distinct()


def p1_status(spark: SparkSession, root: str) -> DataFrame:
    """How many values of each field end in each status and format."""
    resolved = normalize_times(written_times(spark, root), table(spark, root, "harvest_sources"))
    return resolved.groupBy("src_field", "status", "format").agg(F.count("*").alias("n"))


def p1_fitted(spark: SparkSession, root: str) -> DataFrame:
    """What the mixture decides if no source declares its order: per source how many values come out as with it, otherwise, or as ambiguous."""
    values, sources = written_times(spark, root), table(spark, root, "harvest_sources")
    tagged = values.withColumn("src_field", F.concat_ws("\u0000", "src_field", F.coalesce("source", F.lit("")))).distinct()
    told = normalize_times(tagged, sources).select("src_field", "row_key", "value", F.col("utc_us").alias("told"))
    fitted = normalize_times(tagged, sources.withColumn("date_order", F.lit(None).cast("string")))
    both = told.join(fitted, ["src_field", "row_key", "value"]).withColumn("source", F.split_part("src_field", F.lit("\u0000"), F.lit(2)))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    right = F.col("told").isNotNull() & F.col("utc_us").eqNullSafe(F.col("told"))
    return both.groupBy("source").agg(count(F.col("told").isNotNull())("n_known"), count(right)("n_equal"), count(F.col("utc_us").isNotNull() & ~right)("n_other"), count(F.col("status") == "ambiguous_order")("n_ambiguous"))


QUERIES = {"p1_found": p1_found, "p1_status": p1_status, "p1_fitted": p1_fitted}
