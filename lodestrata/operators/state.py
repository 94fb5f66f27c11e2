"""Small state tables: awareness, concepts, sources, runs, queue, index fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def awake(rows: DataFrame, now: str) -> DataFrame:
    """Rows that haven't expired."""
    return rows.filter(F.coalesce(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"), F.lit(True)))


def awareness_top(rows: DataFrame, now: str, limit: int = 10) -> DataFrame:
    return awake(rows, now).orderBy(F.desc("priority"), "id").limit(limit)


def awareness_context(rows: DataFrame, now: str, each: int = 3) -> DataFrame:
    """One line per category: its ``each`` most urgent contents."""
    w = Window.partitionBy("category").orderBy(F.desc("priority"), "id")
    top = awake(rows, now).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= each)
    lines = top.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("nth", "content"))).alias("items"))
    return lines.select("category", F.concat(F.lit("- "), F.array_join(F.transform("items", lambda x: x["content"]), "\n- ")).alias("text"))


def mastery(answers: DataFrame, lowest: int = 1, highest: int = 5) -> DataFrame:
    """concept, mastery_level, times_correct, times_wrong and last_tested after all ``answers(concept, at, id, correct)``.

    A right answer adds one, a wrong one takes one, within the limits; a concept
    begins at the lowest level.  Each day folds to one clamped shift, and clamped
    shifts compose, so no concept's answers are gathered as a whole.
    """
    step = F.when(F.col("correct"), 1).otherwise(-1)
    clamp = lambda c: F.least(F.greatest(c, F.lit(lowest)), F.lit(highest))
    start = F.struct(F.lit(0).alias("shift"), F.lit(lowest).alias("low"), F.lit(highest).alias("high"))

    def then(a: Column, shift: Column, low: Column, high: Column) -> Column:
        within = lambda c: F.least(F.greatest(c, low), high)
        return F.struct((a["shift"] + shift).alias("shift"), within(a["low"] + shift).alias("low"), within(a["high"] + shift).alias("high"))

    days = answers.groupBy("concept", F.to_date("at").alias("day")).agg(F.array_sort(F.collect_list(F.struct("at", "id", step.alias("step")))).alias("steps"), F.sum(F.col("correct").cast("long")).alias("right"), F.count("*").alias("n"), F.max("at").alias("last"))
    folded = days.withColumn("f", F.aggregate("steps", start, lambda a, x: then(a, x["step"], F.lit(lowest), F.lit(highest))))
    whole = folded.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("day", "f"))).alias("fs"), F.sum("right").alias("times_correct"), F.sum("n").alias("n"), F.max("last").alias("last_tested"))
    total = F.aggregate("fs", start, lambda a, x: then(a, x["f"]["shift"], x["f"]["low"], x["f"]["high"]))
    level = F.least(F.greatest(F.lit(lowest) + F.col("t.shift"), F.col("t.low")), F.col("t.high"))
    return whole.withColumn("t", total).select("concept", level.alias("mastery_level"), "times_correct", (F.col("n") - F.col("times_correct")).alias("times_wrong"), "last_tested")


def due(concepts: DataFrame, below: int = 4, limit: int = 20) -> DataFrame:
    return concepts.filter(F.col("mastery_level") < below).orderBy("mastery_level", F.asc_nulls_first("last_tested"), "concept").limit(limit)


def stale_sources(sources: DataFrame, now: str) -> DataFrame:
    """Sources to be synced: never synced, or longer ago than their interval."""
    at = F.lit(now).cast("timestamp_ntz")
    next_at = F.timestamp_add("HOUR", F.coalesce("sync_interval_hours", F.lit(24)), F.col("last_synced_at"))
    return sources.filter((F.col("auto_sync") == 1) & (F.col("last_synced_at").isNull() | (next_at <= at)))


def synced(sources: DataFrame, syncs: DataFrame) -> DataFrame:
    """Sources after ``syncs(source, at, items)``: counts added, times moved on, unknown sources new."""
    sums = syncs.groupBy("source").agg(F.max("at").alias("at"), F.sum("items").alias("items"))
    joined = sources.select("source", "display_name", "items_imported", "last_synced_at").join(sums, "source", "full_outer")
    return joined.select("source", F.coalesce("display_name", "source").alias("display_name"), (F.coalesce("items_imported", F.lit(0)) + F.coalesce("items", F.lit(0))).alias("items_imported"), F.greatest("last_synced_at", "at").alias("last_synced_at"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def interrupted(runs: DataFrame) -> DataFrame:
    """Runs that never finished and may be taken up again, newest first."""
    return runs.filter("finished_at IS NULL AND status IN ('running', 'partial', 'failed')").orderBy(F.desc("started_at"), F.desc("id"))


def queue_state(tasks: DataFrame, events: DataFrame, now: str, reclaim_minutes: int = 30) -> DataFrame:
    """id and status after ``events(id, at, status)``: the latest counts; a task in work for too long is pending again."""
    last = events.groupBy("id").agg(F.max(F.struct("at", "status")).alias("e"))
    status = F.coalesce("e.status", F.lit("pending"))
    late = (status == "working") & (F.col("e.at") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {reclaim_minutes} MINUTES"))
    return tasks.select("id").join(last, "id", "left").select("id", F.when(late, "pending").otherwise(status).alias("status"))


def check_fingerprint(recorded: dict[str, str] | None, model: str, dim: int) -> str:
    """recorded, match or model-changed; another dimension raises."""
    if not recorded:
        return "recorded"
    if int(recorded["dim"]) != dim:
        raise ValueError(f"the index has {recorded['dim']} dimensions, the model {dim}")
    return "match" if recorded["model"] == model else "model-changed"
