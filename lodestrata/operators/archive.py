"""The append-only archive, erasure of subjects, and what depends on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import TURN_HEADER, archive_uid, conversation_key, decision_id, injection
from lodestrata.tables import written

MARKER = "[REDACTED — GDPR Art.17 erasure]"
#: The source whose items decisions are drawn from.
DECISION_SOURCE = "claude-code"


def suppressed(archive: DataFrame) -> DataFrame:
    """source, source_ref and when it was last erased, of every subject of an erased row."""
    return archive.filter("erased_at IS NOT NULL AND source_ref IS NOT NULL").groupBy("source", "source_ref").agg(F.max("erased_at").alias("erased_at"))


def unsuppressed(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """The items whose subject isn't suppressed; an item without a reference has no subject."""
    return items.join(subjects.select("source", "source_ref").distinct(), ["source", "source_ref"], "left_anti")


def appended(items: DataFrame, archive: DataFrame, subjects: DataFrame) -> DataFrame:
    """What appending does with each item: item_id, uid, action (insert, present, suppressed), flags.

    Of items with one uid the first by item_id is inserted.  The first 4000
    characters are probed for attempts to take over a model.
    """
    ref = items.withColumn("source_ref", F.col("item_id"))
    marked = ref.join(subjects.select("source", "source_ref", F.lit(True).alias("hidden")).distinct(), ["source", "source_ref"], "left")
    keyed = marked.withColumn("uid", archive_uid(F.col("source"), F.col("source_ref"), F.col("content"))).withColumn("flags", F.array_join(injection(F.substring("content", 1, 4000), F.lit("tool_output"))["flags"], ","))
    held = archive.select(F.col("archive_uid").alias("uid"), F.lit(True).alias("held")).distinct()
    first = keyed.filter("hidden IS NULL").groupBy("uid").agg(F.min("item_id").alias("first"))
    joined = keyed.join(held, "uid", "left").join(first, "uid", "left")
    action = F.when(F.col("hidden").isNotNull(), "suppressed").when(F.col("held").isNotNull() | (F.col("item_id") != F.col("first")), "present").otherwise("insert")
    return joined.select("item_id", "uid", action.alias("action"), F.coalesce("flags", F.lit("")).alias("flags"))


def redacted(archive: DataFrame, subjects: DataFrame, now: str, reason: str) -> DataFrame:
    """The archive with the rows of ``subjects(source, source_ref)`` redacted, each at most once."""
    hit = F.col("hit").isNotNull() & F.col("erased_at").isNull()
    joined = archive.join(subjects.select("source", "source_ref", F.lit(True).alias("hit")).distinct(), ["source", "source_ref"], "left")
    change = {
        "archive_uid": F.sha2(F.concat(F.col("archive_uid"), F.lit("erased")), 256),
        "content": F.lit(MARKER),
        "content_sha256": F.lit(""),
        "title": F.lit(None).cast("string"),
        "erased_at": F.lit(now).cast("timestamp_ntz"),
        "erased_reason": F.lit(reason),
    }
    return joined.select(*(F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in archive.columns))


def violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose change breaks the archive's rule: id and what happened (deleted, changed, erased twice).

    The only change allowed is a first redaction.
    """
    columns = [c for c in before.columns if c != "id"]
    a = before.select("id", *(F.col(c).alias(f"old_{c}") for c in columns))
    b = after.select("id", F.lit(True).alias("there"), *columns)
    joined = a.join(b, "id", "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    redaction = F.col("old_erased_at").isNull() & F.col("erased_at").isNotNull() & (F.col("content") == MARKER) & (F.col("content_sha256") == "")
    what = F.when(F.col("there").isNull(), "deleted").when(same | redaction, None).when(F.col("old_erased_at").isNotNull(), "erased twice").otherwise("changed")
    return joined.select("id", what.alias("what")).filter("what IS NOT NULL")


def linked_uids(frames: DataFrame) -> DataFrame:
    """frame_id and archive_uid of every link in the metadata, in either spelling."""
    many = F.coalesce(F.from_json(F.get_json_object("metadata", "$.archiveUids"), "array<string>"), F.array().cast("array<string>"))
    return frames.select(F.col("id").alias("frame_id"), F.explode(F.array_union(many, F.array_compact(F.array(F.get_json_object("metadata", "$.archiveUid"))))).alias("archive_uid"))


def referring(frames: DataFrame, gone: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``gone(id)`` and every bridge frame that refers to a frame that goes, to the end of all chains."""
    bridges = frames.filter("frame_type = 'B'")
    refs = bridges.select("id", F.explode(F.from_json(F.get_json_object("content", "$.references"), "array<bigint>")).alias("ref"))
    refs = written(refs.distinct(), "references")
    seen = written(gone.select("id").distinct(), "gone")
    frontier = seen
    for _ in range(max_rounds):
        step = refs.join(frontier.select(F.col("id").alias("ref")), "ref").select("id").distinct()
        frontier = written(step.join(seen, "id", "left_anti"), "gone")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"references go deeper than {max_rounds}")


def erased_frames(frames: DataFrame, archive: DataFrame, subjects: DataFrame) -> DataFrame:
    """id of every frame to delete when ``subjects`` are erased.

    A frame goes if it is linked to a row of theirs, holds a turn of a conversation
    of theirs, or names one as its origin in metadata and content; then every
    bridge frame that refers to one that goes.  Decisions drawn from a subject are
    subjects of their own and go with it.
    """
    subjects = with_decisions(subjects)
    rows = archive.join(subjects, ["source", "source_ref"], "left_semi").select("archive_uid")
    linked = linked_uids(frames).join(rows, "archive_uid", "left_semi").select(F.col("frame_id").alias("id"))
    turn = F.regexp_extract("content", TURN_HEADER, 1)
    keys = subjects.select(conversation_key(F.col("source_ref")).alias("conv")).distinct()
    turns = frames.select("id", turn.alias("conv")).filter("conv <> ''").join(keys, "conv", "left_semi").select("id")
    origin = frames.select("id", F.regexp_extract("content", r"^\[(?:Harvest:)?([^\]]+)\]", 1).alias("source"), F.get_json_object("metadata", "$.sourceId").alias("source_ref"))
    named = origin.filter("source <> '' AND source_ref IS NOT NULL").join(subjects, ["source", "source_ref"], "left_semi").select("id")
    return referring(frames, linked.unionByName(turns).unionByName(named).distinct())


def with_decisions(subjects: DataFrame) -> DataFrame:
    """``subjects(source, source_ref)`` and the decisions drawn from them."""
    given = subjects.select("source", "source_ref").distinct()
    drawn = given.filter(F.col("source") == DECISION_SOURCE).select("source", decision_id(F.col("source_ref")).alias("source_ref"))
    return given.unionByName(drawn).distinct()


def lonely_entities(bridge: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities that only deleted frames mention."""
    left = bridge.join(gone.select(F.col("id").alias("frame_id")), "frame_id", "left_anti").select("entity_id").distinct()
    return bridge.join(gone.select(F.col("id").alias("frame_id")), "frame_id", "left_semi").select("entity_id").distinct().join(left, "entity_id", "left_anti")
