"""Queries on ingestion stages, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fixed
from lodestrata.operators import pipeline as op
from lodestrata.plans.frames import frames
from lodestrata.plans.texts import _re
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


@query("""SELECT id, list_transform(range(1, 17), lambda i: CASE WHEN i <= octet_length(encode(c)) THEN ((('0x' || substr(hex(encode(c)), 2 * i::INT - 1, 2))::INT - 128) / 128.0)::FLOAT ELSE 0::FLOAT END) AS embedding FROM (SELECT id, left(content, 6000) AS c FROM memory_frames WHERE content IS NOT NULL)""")
def mock_embed(spark: SparkSession, root: str) -> DataFrame:
    return op.embedded(frames(spark, root).select("id", F.col("content").alias("text")), op.byte_embedding(16), 16)


@query()
def semantic_chunks(spark, root):
    return op.chunks(frames(spark, root))


@query(f"""SELECT id, regexp_matches(left(coalesce(title, '') || chr(10) || content, 4000), '{_re(fixed.ROLE_OVERRIDE)}') OR regexp_matches(left(coalesce(title, '') || chr(10) || content, 4000), '{_re(fixed.PROMPT_EXTRACTION)}') OR regexp_matches(left(coalesce(title, '') || chr(10) || content, 4000), '{_re(fixed.INSTRUCTION_INJECTION)}') AS blocked FROM raw_archive WHERE content IS NOT NULL""")
def pipeline_gate(spark, root):
    return op.screened(table(spark, root, "raw_archive").filter("content IS NOT NULL")).select("id", "blocked")


@query(r"""WITH m AS (SELECT DISTINCT item_id, msg_idx, msg_role, text FROM conversation_messages WHERE msg_role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''
    AND length(text) <= 10000 AND NOT (regexp_matches(text, '""" + _re(fixed.ROLE_OVERRIDE) + r"""') OR regexp_matches(text, '""" + _re(fixed.PROMPT_EXTRACTION) + r"""') OR regexp_matches(text, '""" + _re(fixed.INSTRUCTION_INJECTION) + r"""')))
    SELECT item_id AS conv, row_number() OVER (PARTITION BY item_id ORDER BY msg_idx, text) - 1 AS turn, '[mind-rawturn conv:' || substr(regexp_replace(item_id, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 64) || ' turn:' || (row_number() OVER (PARTITION BY item_id ORDER BY msg_idx, text) - 1) || ' speaker:' || msg_role || ']' || chr(10) || substr(text, 1, 2000) AS content FROM m""")
def raw_turn_writer(spark, root):
    m = table(spark, root, "conversation_messages").select(F.col("item_id").alias("conv"), F.col("msg_idx").alias("turn"), F.col("msg_role").alias("role"), "text").distinct().withColumn("at", F.lit(None).cast("string"))
    return op.turn_frames(m).select("conv", F.col("turn").cast("long").alias("turn"), "content")


@query("""SELECT kind, speaker, '[' || kind || ' speaker:' || speaker || coalesce(' day:' || day, '') || '] ' || text AS content FROM (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'fact' ELSE 'event' END AS kind, user_id::VARCHAR AS speaker, event_type AS text, CASE WHEN event_type <> 'view' THEN ts::DATE::VARCHAR END AS day FROM events WHERE event_type <> 'signup')
    UNION ALL SELECT kind, speaker, '[profile speaker:' || speaker || '] ' || text FROM (SELECT 'profile' AS kind, user_id::VARCHAR AS speaker, arg_max(props, (ts, props)) AS text FROM events WHERE event_type = 'signup' GROUP BY 2)""")
def lane_writer(spark, root):
    e = table(spark, root, "events")
    kind = F.when(F.col("event_type") == "view", "fact").when(F.col("event_type") == "signup", "profile").otherwise("event")
    x = e.select(kind.alias("kind"), F.col("user_id").cast("string").alias("speaker"), F.when(F.col("event_type") == "signup", F.col("props")).otherwise(F.col("event_type")).alias("text"), F.when(~F.col("event_type").isin("view", "signup"), F.to_date("ts")).alias("day"), F.col("ts").alias("seen"))
    return op.lane_frames(x)


@query(r"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY mind ORDER BY created_at DESC, id DESC) AS k FROM memory_frames WHERE created_at >= TIMESTAMP '2025-06-01' - INTERVAL 60 DAY AND created_at < TIMESTAMP '2025-06-01')
    SELECT mind, count(*) AS n, string_agg('- [' || strftime(created_at, '%Y-%m-%d') || '] ' || substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 80), chr(10) ORDER BY k) FILTER (k <= 12) AS text FROM k GROUP BY 1""")
def digest_text(spark, root):
    return op.digest(frames(spark, root), "2025-06-01 00:00:00", 60)
