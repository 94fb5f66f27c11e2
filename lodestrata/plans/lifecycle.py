"""Queries on the archive, erasure and state tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fixed
from lodestrata.functions.text import TURN_HEADER
from lodestrata.operators import archive as op
from lodestrata.operators import state
from lodestrata.plans.frames import NOW
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


def archive(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "raw_archive")


_SUP = "(SELECT source, source_ref, max(erased_at) AS erased_at FROM raw_archive WHERE erased_at IS NOT NULL AND source_ref IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT * FROM {_SUP}")
def suppression_list(spark, root):
    return op.suppressed(archive(spark, root))


@query(f"SELECT i.item_id, i.source FROM import_items i WHERE NOT EXISTS (SELECT 1 FROM {_SUP} s WHERE s.source = i.source AND s.source_ref = i.item_id)")
def suppression_antijoin(spark, root):
    items = table(spark, root, "import_items").withColumn("source_ref", F.col("item_id"))
    return op.unsuppressed(items, op.suppressed(archive(spark, root))).select("item_id", "source")


@query(f"""WITH s AS {_SUP}, k AS (SELECT i.item_id, s.source IS NOT NULL AS hidden, sha256(coalesce(i.source, '') || chr(0) || i.item_id || chr(0) || coalesce(i.content, '')) AS uid, left(content, 4000) AS c FROM import_items i LEFT JOIN s ON s.source = i.source AND s.source_ref = i.item_id),
    f AS (SELECT uid, min(item_id) AS first FROM k WHERE NOT hidden GROUP BY 1)
    SELECT k.item_id, k.uid, CASE WHEN hidden THEN 'suppressed' WHEN k.uid IN (SELECT archive_uid FROM raw_archive) OR k.item_id <> f.first THEN 'present' ELSE 'insert' END AS action,
    concat_ws(',', CASE WHEN regexp_matches(c, '{_re(fixed.ROLE_OVERRIDE)}') THEN 'role_override' END, CASE WHEN regexp_matches(c, '{_re(fixed.PROMPT_EXTRACTION)}') THEN 'prompt_extraction' END, CASE WHEN regexp_matches(c, '{_re(fixed.INSTRUCTION_INJECTION)}') THEN 'instruction_injection' END) AS flags
    FROM k LEFT JOIN f USING (uid)""")
def archive_append(spark, root):
    return op.appended(table(spark, root, "import_items"), archive(spark, root), op.suppressed(archive(spark, root)))


_SUBJECTS = "(SELECT DISTINCT source, item_id AS source_ref FROM import_items WHERE source = 'cursor')"
_HIT = f"EXISTS (SELECT 1 FROM {_SUBJECTS} s WHERE s.source = a.source AND s.source_ref = a.source_ref)"


def subjects(spark, root) -> DataFrame:
    return table(spark, root, "import_items").filter("source = 'cursor'").select("source", F.col("item_id").alias("source_ref")).distinct()


@query(f"""SELECT id, CASE WHEN h THEN sha256(archive_uid || 'erased') ELSE archive_uid END AS archive_uid, CASE WHEN h THEN '{op.MARKER}' ELSE content END AS content, CASE WHEN h THEN NULL ELSE title END AS title,
    CASE WHEN h THEN TIMESTAMP '{NOW}' ELSE erased_at END AS erased_at FROM (SELECT *, {_HIT} AND erased_at IS NULL AS h FROM raw_archive a)""")
def archive_redact(spark, root):
    return op.redacted(archive(spark, root), subjects(spark, root), NOW, "request").select("id", "archive_uid", "content", "title", "erased_at")


@query("SELECT id, CASE WHEN id % 101 = 0 THEN 'deleted' WHEN erased_at IS NOT NULL THEN 'erased twice' ELSE 'changed' END AS what FROM raw_archive WHERE id % 101 = 0 OR id % 97 = 0")
def archive_violations(spark, root):
    before = archive(spark, root)
    after = op.redacted(before, subjects(spark, root), NOW, "request").filter("id % 101 <> 0")
    after = after.withColumn("content", F.when(F.col("id") % 97 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return op.violations(before, after)


_GONE = f"""WITH RECURSIVE u AS (SELECT id, unnest(list_concat(coalesce(from_json(json_extract(metadata, '$.archiveUids'), '["VARCHAR"]'), []), CASE WHEN json_extract_string(metadata, '$.archiveUid') IS NULL THEN [] ELSE [json_extract_string(metadata, '$.archiveUid')] END)) AS uid FROM memory_frames WHERE metadata IS NOT NULL),
    r AS (SELECT id, unnest(from_json(json_extract(content, '$.references'), '["BIGINT"]')) AS ref FROM memory_frames WHERE frame_type = 'B' AND json_valid(content)),
    g(id) AS (SELECT DISTINCT u.id FROM u JOIN raw_archive a ON a.archive_uid = u.uid WHERE {_HIT} UNION SELECT id FROM memory_frames WHERE regexp_extract(content, '{TURN_HEADER}', 1) IN (SELECT substr(regexp_replace(item_id, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 64) FROM import_items WHERE source = 'cursor')
        UNION SELECT f.id FROM memory_frames f JOIN import_items i ON i.source = 'cursor' AND regexp_extract(f.content, '^\\[(?:Harvest:)?([^\\]]+)\\]', 1) = i.source AND json_extract_string(f.metadata, '$.sourceId') = i.item_id
        UNION SELECT r.id FROM r JOIN g ON r.ref = g.id)"""


@query(_GONE + " SELECT id FROM g")
def erase_subject(spark, root):
    return op.erased_frames(table(spark, root, "memory_frames"), archive(spark, root), subjects(spark, root))


@query(f"""WITH RECURSIVE r AS (SELECT id, unnest(from_json(json_extract(content, '$.references'), '["BIGINT"]')) AS ref FROM memory_frames WHERE frame_type = 'B' AND json_valid(content)),
    g(id) AS (SELECT id FROM memory_frames WHERE source = 'system' UNION SELECT r.id FROM r JOIN g ON r.ref = g.id) SELECT id FROM g""")
def bframe_fixpoint(spark, root):
    f = table(spark, root, "memory_frames")
    return op.referring(f, f.filter("source = 'system'").select("id"))


_BRIDGE = "b AS (SELECT DISTINCT e.id AS entity_id, f.id AS frame_id FROM memory_frames f JOIN knowledge_entities e ON e.valid_to IS NULL AND length(e.name) >= 3 AND contains(lower(f.content), lower(e.name)))"


@query(_GONE + f", {_BRIDGE} SELECT DISTINCT entity_id FROM b WHERE frame_id IN (SELECT id FROM g) AND entity_id NOT IN (SELECT entity_id FROM b WHERE frame_id NOT IN (SELECT id FROM g))")
def orphan_entity_sweep(spark, root):
    from lodestrata.operators.graph import active, mentions

    e = active(table(spark, root, "knowledge_entities"))
    hits = mentions(table(spark, root, "memory_frames").select("id", F.col("content").alias("text")), e.select("name"))
    bridge = hits.join(e.select(F.col("id").alias("entity_id"), F.lower("name").alias("name")), "name").select("entity_id", F.col("id").alias("frame_id")).distinct()
    return op.lonely_entities(bridge, erase_subject(spark, root))


@query("SELECT id, created_at FROM raw_archive ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def archive_page(spark, root):
    return archive(spark, root).orderBy(F.desc("created_at"), F.desc("id")).offset(100).limit(50).select("id", "created_at")


_AWARE = """a AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'action' WHEN 'error' THEN 'flag' WHEN 'signup' THEN 'pending' ELSE 'task' END AS category, event_type || ' by ' || user_id AS content, (event_id % 10)::INT AS priority,
    CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 10 DAY END AS expires_at FROM events)"""


def awareness(spark, root) -> DataFrame:
    e = table(spark, root, "events")
    category = F.when(F.col("event_type") == "purchase", "action").when(F.col("event_type") == "error", "flag").when(F.col("event_type") == "signup", "pending").otherwise("task")
    return e.select(F.col("event_id").alias("id"), category.alias("category"), F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("content"), (F.col("event_id") % 10).cast("int").alias("priority"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))


@query(f"WITH {_AWARE} SELECT id, category, priority FROM a WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25' ORDER BY priority DESC, id LIMIT 10")
def awareness_active(spark, root):
    return state.awareness_top(awareness(spark, root), "2024-01-25 00:00:00").select("id", "category", "priority")


@query(f"WITH {_AWARE}, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, id) AS nth FROM a WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25') SELECT category, '- ' || string_agg(content, chr(10) || '- ' ORDER BY nth) AS text FROM t WHERE nth <= 3 GROUP BY 1")
def awareness_context(spark, root):
    return state.awareness_context(awareness(spark, root), "2024-01-25 00:00:00")


@query(f"WITH {_AWARE} SELECT a.id, priority FROM a JOIN events e ON e.event_id = a.id WHERE json_extract_string(props, '$.k') = '7' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25') ORDER BY priority DESC, a.id")
def awareness_by_status(spark, root):
    """Items of one status that haven't expired, most urgent first."""
    rows = awareness(spark, root).join(table(spark, root, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("status")), "id")
    return state.awake(rows.filter("status = '7'"), "2024-01-25 00:00:00").orderBy(F.desc("priority"), "id").select("id", "priority")


_MASTERY = """m AS (SELECT user_id AS concept, list_reduce(list_prepend(1, list(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END ORDER BY ts, event_id)), lambda a, b: greatest(1, least(5, a + b)))::INT AS mastery_level,
    count(*) FILTER (event_type = 'purchase') AS times_correct, count(*) FILTER (event_type = 'error') AS times_wrong, max(ts) AS last_tested FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)"""


def concepts(spark, root) -> DataFrame:
    answers = table(spark, root, "events").filter("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("concept"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("correct"))
    return state.mastery(answers)


@query(f"WITH {_MASTERY} SELECT * FROM m")
def concept_answers(spark, root):
    return concepts(spark, root)


@query(f"WITH {_MASTERY} SELECT concept, mastery_level, last_tested FROM m WHERE mastery_level < 4 ORDER BY mastery_level, last_tested NULLS FIRST, concept LIMIT 20")
def due_for_review(spark, root):
    return state.due(concepts(spark, root)).select("concept", "mastery_level", "last_tested")


@query(f"SELECT source FROM harvest_sources WHERE auto_sync = 1 AND (last_synced_at IS NULL OR last_synced_at + to_hours(coalesce(sync_interval_hours, 24)) <= TIMESTAMP '{NOW}')")
def sources_stale(spark, root):
    return state.stale_sources(table(spark, root, "harvest_sources"), NOW).select("source")


@query("""WITH s AS (SELECT source, max(finished_at) AS at_, sum(items_saved) AS items FROM harvest_runs GROUP BY 1)
    SELECT coalesce(h.source, s.source) AS source, coalesce(display_name, h.source, s.source) AS display_name, coalesce(items_imported, 0) + coalesce(items, 0)::BIGINT AS items_imported, greatest(last_synced_at, at_) AS last_synced_at FROM harvest_sources h FULL JOIN s ON s.source = h.source""")
def sources_synced(spark, root):
    syncs = table(spark, root, "harvest_runs").select("source", F.col("finished_at").alias("at"), F.col("items_saved").cast("long").alias("items"))
    return state.synced(table(spark, root, "harvest_sources"), syncs)


@query("SELECT source, id, status FROM harvest_runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) = 1")
def run_latest(spark, root):
    return state.latest_runs(table(spark, root, "harvest_runs")).select("source", "id", "status")


@query("SELECT id, source, status FROM harvest_runs WHERE finished_at IS NULL AND status IN ('running', 'partial', 'failed') ORDER BY started_at DESC, id DESC")
def runs_interrupted(spark, root):
    return state.interrupted(table(spark, root, "harvest_runs")).select("id", "source", "status")


@query("""WITH e AS (SELECT user_id AS id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'working' END AS status FROM events), l AS (SELECT id, ts, status FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, status DESC) = 1)
    SELECT c_custkey AS id, CASE WHEN status = 'working' AND ts <= TIMESTAMP '2024-01-30' - INTERVAL 30 MINUTE THEN 'pending' ELSE coalesce(status, 'pending') END AS status FROM customer LEFT JOIN l ON l.id = c_custkey""")
def queue_state(spark, root):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("working")
    events = table(spark, root, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), kind.alias("status"))
    return state.queue_state(table(spark, root, "customer").select(F.col("c_custkey").alias("id")), events, "2024-01-30 00:00:00")
