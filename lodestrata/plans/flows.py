"""Queries on exports and streams, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources import exports
from lodestrata.streaming import feeds
from lodestrata.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _export(spark: SparkSession, root: str) -> DataFrame:
    """Each item's messages as one tool would export them."""
    m = table(spark, root, "conversation_messages").select("msg_id", "item_id", "msg_idx", "msg_role", "text").distinct()
    node = F.struct(F.struct(F.struct(F.col("msg_role").alias("role")).alias("author"), F.struct(F.array(F.coalesce("text", F.lit(""))).alias("parts")).alias("content"), F.col("msg_idx").alias("create_time")).alias("message"))
    mapping = m.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("msg_id").cast("string"), node))).alias("mapping"))
    conv = F.to_json(F.array(F.struct(F.col("item_id").alias("id"), F.concat(F.lit("about "), "item_id").alias("title"), "mapping")))
    return mapping.select(F.col("item_id").alias("export_id"), F.lit("chatgpt").alias("source"), conv.alias("payload"))


_KEPT = "m AS (SELECT DISTINCT msg_id, item_id, msg_idx, CASE WHEN msg_role = 'user' THEN 'user' ELSE 'assistant' END AS role, regexp_replace(regexp_replace(text, '^[\\s\\x{00a0}]+', ''), '[\\s\\x{00a0}]+$', '') AS text FROM conversation_messages WHERE msg_role IN ('user', 'assistant', 'tool') AND trim(coalesce(text, '')) <> '')"


@query(f"WITH {_KEPT} SELECT item_id AS conv_id, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM m GROUP BY 1, 2")
def export_messages(spark, root):
    read = exports.messages(_export(spark, root))
    return read.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {_KEPT} SELECT substr(sha256('chatgpt' || chr(0) || item_id), 1, 40) AS item_id, 'about ' || item_id AS title, count(*) AS n_messages FROM m GROUP BY item_id")
def export_items(spark, root):
    return exports.items(exports.messages(_export(spark, root))).select("item_id", "title", F.col("n_messages").cast("long").alias("n_messages"))


def _shaped(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Each item's messages in another tool's shape; these keep the order of the list."""
    m = table(spark, root, "conversation_messages").select("msg_id", "item_id", "msg_idx", "msg_role", "text").distinct()
    text = F.coalesce("text", F.lit(""))
    entry = {
        "claude": F.struct(F.when(F.col("msg_role") == "user", "human").otherwise(F.col("msg_role")).alias("sender"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")),
        "gemini": F.struct(F.when(F.col("msg_role") == "assistant", "model").otherwise(F.col("msg_role")).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts")),
        "perplexity": F.struct(F.col("msg_role").alias("role"), text.alias("content")),
    }[source]
    rows = m.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "msg_id", entry.alias("m")))).alias("rows")).withColumn("entries", F.transform("rows", lambda r: r["m"]))
    named = F.concat(F.lit("about "), "item_id")
    payload = {
        "claude": F.struct(F.array(F.struct(F.col("item_id").alias("uuid"), named.alias("name"), F.col("entries").alias("chat_messages"))).alias("conversations")),
        "gemini": F.array(F.struct(F.col("item_id").alias("conversationId"), named.alias("title"), F.col("entries").alias("messages"))),
        "perplexity": F.struct(F.array(F.struct(F.col("item_id").alias("threadId"), named.alias("title"), F.col("entries").alias("messages"))).alias("threads")),
    }[source]
    return rows.select(F.col("item_id").alias("export_id"), F.lit(source).alias("source"), F.to_json(payload).alias("payload"))


def _register_shape(source: str) -> None:
    def read(spark, root):
        got = exports.messages(_shaped(spark, root, source))
        return got.groupBy("conv_id", "title", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))

    QUERIES[f"export_{source}"] = read
    SQL[f"export_{source}"] = f"WITH {_KEPT} SELECT item_id AS conv_id, 'about ' || item_id AS title, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM m GROUP BY ALL"


for _source in ("claude", "gemini", "perplexity"):
    _register_shape(_source)


@query("""SELECT id, CASE WHEN contains(l, 'perplexity') THEN 'perplexity' WHEN contains(l, 'grok') OR contains(l, 'x.ai') THEN 'grok' WHEN contains(l, 'manus') THEN 'manus' WHEN contains(l, 'genspark') THEN 'genspark' WHEN contains(l, 'qwen') OR contains(l, 'tongyi') THEN 'qwen'
    WHEN contains(l, 'minimax') THEN 'minimax' WHEN contains(l, 'elevenlabs') THEN 'elevenlabs' ELSE 'unknown' END AS detected FROM (SELECT id, lower(content) AS l FROM raw_archive WHERE content IS NOT NULL)""")
def source_detection(spark, root):
    return table(spark, root, "raw_archive").filter("content IS NOT NULL").select("id", exports.source_of_text(F.col("content")).alias("detected"))


def _events(spark, root) -> DataFrame:
    return feeds.stream(spark, f"{root}/events.parquet", table(spark, root, "events").schema)


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, root):
    return feeds.tumbling_counts(spark, _events(spark, root), "ts", "event_type")


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def stream_admitted(spark, root):
    return feeds.admit_new(spark, _events(spark, root), "user_id").select("user_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 500")
def stream_watermark(spark, root):
    return feeds.after_watermark(table(spark, root, "events"), "event_id", 500, 500).select("event_id", "event_type")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 30 MINUTE GROUP BY 1")
def event_sessions(spark, root):
    e = table(spark, root, "events").withColumn("at", F.col("ts").cast("timestamp"))
    sessions = e.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.count("*").alias("k"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"))
