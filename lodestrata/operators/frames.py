"""Operators on the table of memory frames: reads, statistics, and writes as functions from tables to tables.

``now`` is always a parameter.  Orders are total: ties go to the smaller or
larger id, as said.  Empty tables give empty results, nulls in keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import fixed
from lodestrata.functions.text import frame_hash


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def statistics(frames: DataFrame) -> DataFrame:
    """kind (total, frame_type, importance), value, n — in one pass."""
    grouped = frames.groupingSets([[], ["frame_type"], ["importance"]], "frame_type", "importance").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "frame_type").otherwise("importance")
    return grouped.select(kind.alias("kind"), F.coalesce(F.when(F.col("g") == 1, F.col("frame_type")).when(F.col("g") == 2, F.col("importance")), F.lit("")).alias("value"), "n")


def recent(frames: DataFrame, limit: int = 50, since: str | None = None, until: str | None = None) -> DataFrame:
    """The newest frames by id; bounds are inclusive instants, a bound of ten characters means that whole day."""
    return within(frames, since, until).orderBy(F.desc("id")).limit(limit)


def within(frames: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    at = F.col("created_at")
    if since is not None:
        frames = frames.filter(at >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        end = F.lit(until).cast("timestamp_ntz")
        frames = frames.filter(at < end + F.expr("INTERVAL 1 DAY") if len(until) == 10 else at <= end)
    return frames


def latest_base(frames: DataFrame) -> DataFrame:
    """The I frame with the largest t of each group."""
    base = frames.filter("frame_type = 'I'")
    last = base.groupBy(F.col("gop_id").alias("g")).agg(F.max(F.struct("t", "id")).alias("last"))
    return base.join(last, (F.col("g").eqNullSafe(F.col("gop_id"))) & (F.col("last.id") == F.col("id"))).select(*frames.columns)


def deltas_since_base(frames: DataFrame) -> DataFrame:
    """P frames after the latest I frame of their group, with its id."""
    base = frames.filter("frame_type = 'I'").groupBy("gop_id").agg(F.max(F.struct("t", "id")).alias("base"))
    return frames.filter("frame_type = 'P'").join(base, "gop_id").filter(F.col("t") > F.col("base.t")).withColumn("latest_i", F.col("base.id")).drop("base").select(*frames.columns, "latest_i")


def state(frames: DataFrame) -> DataFrame:
    """gop_id, base_id and the ids of its deltas in order."""
    deltas = deltas_since_base(frames).groupBy("gop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("delta_ids"))
    return latest_base(frames).select("gop_id", F.col("id").alias("base_id")).join(deltas, "gop_id", "left").select("gop_id", "base_id", F.coalesce("delta_ids", F.array().cast("array<bigint>")).alias("delta_ids"))


def next_t(frames: DataFrame) -> DataFrame:
    return frames.groupBy("gop_id").agg((F.coalesce(F.max("t"), F.lit(-1)) + 1).alias("next_t"))


def invalid(frames: DataFrame) -> DataFrame:
    """Rows that break an enumeration, with what they break."""
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("frame_type").isin(*fixed.FRAME_TYPES), F.lit(False)), F.lit("frame_type")), F.when(~F.coalesce(F.col("importance").isin(*fixed.IMPORTANCES), F.lit(False)), F.lit("importance"))))
    return frames.select("id", F.array_join(bad, ",").alias("broken")).filter("broken <> ''")


def admit(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What writing I frames does: action insert or touch, frame_id, and how often.

    Contents are equal by the hash of their body.  A content that is stored only
    touches its newest frame; of equal new contents the first is inserted and the
    others touch it.
    """
    hashed = incoming.withColumn("h", frame_hash(F.col("content"))).filter("h IS NOT NULL")
    newest = stored.withColumn("h", frame_hash(F.col("content"))).groupBy("h").agg(F.max("id").alias("stored_id"))
    groups = hashed.groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).join(newest, "h", "left")
    return groups.select(F.when(F.col("stored_id").isNull(), "insert").otherwise("touch").alias("action"), F.coalesce("stored_id", "first_id").alias("frame_id"), (F.col("n") - F.when(F.col("stored_id").isNull(), 1).otherwise(0)).alias("touches"))


def touched(frames: DataFrame, touches: DataFrame) -> DataFrame:
    """id, access_count and last_accessed after the touches (frame_id, n, at)."""
    sums = touches.groupBy("frame_id").agg(F.sum("n").alias("more"), F.max("at").alias("at"))
    joined = frames.join(sums, F.col("id") == F.col("frame_id"), "left")
    return joined.select("id", (F.col("access_count") + F.coalesce("more", F.lit(0))).alias("access_count"), F.greatest("last_accessed", "at").alias("last_accessed"))


def updated(frames: DataFrame, changes: DataFrame) -> DataFrame:
    """id, content, importance and hash after ``changes(id, content, importance)``; null importance keeps the old one."""
    new = changes.select(F.col("id").alias("c_id"), F.col("content").alias("new"), F.col("importance").alias("new_importance"))
    joined = frames.join(new, F.col("id") == F.col("c_id"), "left")
    content = F.when(F.col("c_id").isNotNull(), F.col("new")).otherwise(F.col("content"))
    return joined.select("id", content.alias("content"), F.coalesce("new_importance", "importance").alias("importance"), frame_hash(content).alias("content_hash"), F.col("c_id").isNotNull().alias("reindex"))


def deleted(frames: DataFrame, gone: DataFrame) -> DataFrame:
    """The frames left after deleting ``gone(id)``; bases that are gone become null."""
    left = frames.join(gone.select("id"), "id", "left_anti")
    lost = gone.select(F.col("id").alias("base_frame_id"), F.lit(True).alias("lost")).distinct()
    return left.join(lost, "base_frame_id", "left").withColumn("base_frame_id", F.when(F.col("lost").isNull(), F.col("base_frame_id"))).drop("lost")


def expired(frames: DataFrame, now: str, temporary_days: int = 30, deprecated_days: int = 90) -> DataFrame:
    """The frames that compaction prunes."""
    at = F.lit(now).cast("timestamp_ntz")
    age = lambda d: F.col("created_at") < at - F.expr(f"INTERVAL {d} DAYS")
    return frames.filter(((F.col("importance") == "temporary") & age(temporary_days)) | ((F.col("importance") == "deprecated") & age(deprecated_days)))


def merged(frames: DataFrame, more_than: int = 10, keep: int = 5) -> DataFrame:
    """Groups with more than ``more_than`` deltas since their base: all but the newest ``keep`` fold into it.

    Result: gop_id, base_id, merged_ids in order, content of the new base.
    """
    w = Window.partitionBy("gop_id")
    nth = deltas_since_base(frames).withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("t"), F.desc("id"))))
    old = nth.filter((F.col("n") > more_than) & (F.col("back") > keep))
    folded = old.groupBy("gop_id", F.col("latest_i").alias("base_id")).agg(F.array_sort(F.collect_list(F.struct("t", "id", "content"))).alias("parts"))
    base = frames.select(F.col("id").alias("base_id"), F.col("content").alias("base_content"))
    return folded.join(base, "base_id").select("gop_id", "base_id", F.transform("parts", lambda p: p["id"]).alias("merged_ids"), F.concat_ws("\n---\n", F.array("base_content"), F.transform("parts", lambda p: p["content"])).alias("content"))


def importance_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "important", 1)


def important_lane(frames: DataFrame, k: int = 5) -> DataFrame:
    """Critical frames first, then important ones, newest first."""
    rank = importance_rank(F.col("importance"))
    return frames.filter(rank.isNotNull()).orderBy(rank, F.desc("id")).limit(k)
