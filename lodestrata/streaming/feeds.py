"""Incremental work over files that keep arriving, as Structured Streaming.

Each function runs until all data present is processed (available now) and
returns the table it wrote; the same checkpoint continues where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.tables import scratch_path


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files below ``path``, or the one file it is."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def _run(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def tumbling_counts(spark: SparkSession, events: DataFrame, at: str, key: str, width: str = "7 days", late: str = "1 day", folder: str | None = None) -> DataFrame:
    """window start, key and n of every window, open ones included: complete mode into a table."""
    folder = folder or scratch_path(spark, "windows")
    timed = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), key, "n")
    _run(counts, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/table"), f"{folder}/checkpoint", "complete")
    return spark.read.parquet(f"{folder}/table")


def admit_new(spark: SparkSession, rows: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """The first row of each key over all batches: what a batch brings again is left out."""
    folder = folder or scratch_path(spark, "admitted")
    target = f"{folder}/table"

    def sink(df: DataFrame, n: int) -> None:
        first = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
        if n:
            first = first.join(df.sparkSession.read.parquet(target).filter(F.col("batch") < n).select(key), key, "left_anti").select(*df.columns)
        # One folder per batch: a batch that is run again overwrites its own.
        first.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    _run(rows, sink, f"{folder}/checkpoint")
    return spark.read.parquet(target).drop("batch")


def dirty_keys(spark: SparkSession, events: DataFrame, at: str, key: str, quiet: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Keys to be worked on: one entry per key within the watermark of ``quiet``."""
    folder = folder or scratch_path(spark, "dirty")
    once = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", quiet).dropDuplicatesWithinWatermark([key]).select(key)
    _run(once, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/table"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/table").drop("batch")


def after_watermark(rows: DataFrame, key: str, last: int, limit: int | None = None) -> DataFrame:
    """Rows with an id above the last one processed, in order: late event times don't matter."""
    new = rows.filter(F.col(key) > last).orderBy(key)
    return new if limit is None else new.limit(limit)
