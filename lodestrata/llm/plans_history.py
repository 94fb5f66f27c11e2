"""Queries on copies among archived contents (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.history import History, vectors
from lodestrata.tables import scratch_path, table, written


def live_contents(spark: SparkSession, root: str) -> DataFrame:
    archive = table(spark, root, "raw_archive")
    return archive.filter("erased_at IS NULL AND NOT (coalesce(content_sha256, '') = '' AND content LIKE '[REDACTED%')").select("id", "run_id", "content")


def classes(spark: SparkSession, root: str) -> DataFrame:
    """id and class_id of every live row, the first half of the runs admitted first, the other half against it."""
    live = live_contents(spark, root)
    middle = live.agg(F.percentile_approx("run_id", 0.5).alias("m")).first()["m"]
    border = live.filter(F.col("run_id") > F.lit(middle)).agg(F.min("id").alias("b")).first()["b"]
    texts = written(vectors(live), "history-texts", "zstd")
    index = History(spark, scratch_path(spark, "history"))
    index.fit(texts)
    parts = [texts] if border is None else [texts.filter(F.col("id") < border), texts.filter(F.col("id") >= border)]
    done = [index.admit_texts(p) for p in parts]
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return classes(spark, root).filter("class_id <> id").select(F.col("class_id").alias("first_id"), F.col("id").alias("copy_id"))


def p5_runs(spark: SparkSession, root: str) -> DataFrame:
    """Per run: live rows, new contents and duplicates skipped."""
    rows = live_contents(spark, root).select("id", "run_id")
    known = rows.join(classes(spark, root), "id", "left").withColumn("is_copy", F.coalesce(F.col("class_id") != F.col("id"), F.lit(False)))
    return known.groupBy("run_id").agg(F.count("*").alias("rows"), F.sum((~F.col("is_copy")).cast("long")).alias("accepted"), F.sum(F.col("is_copy").cast("long")).alias("duplicates_skipped"))


QUERIES = {"p5_found": p5_found, "p5_runs": p5_runs}
