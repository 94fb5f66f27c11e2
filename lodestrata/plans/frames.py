"""Queries on memory frames, chunks and sessions, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import frames as op
from lodestrata.tables import table

NOW = "2025-12-31 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def frames(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "memory_frames")


_HASH = r"sha256(regexp_replace(regexp_replace(regexp_replace({c}, '^\[hm [^\]]*\]\s*', ''), '^[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ''), '[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+$', ''))"


def body_hash(c: str) -> str:
    return _HASH.format(c=c)


@query("""SELECT 'total' AS kind, '' AS "value", count(*) AS n FROM memory_frames UNION ALL
    SELECT 'frame_type', coalesce(frame_type, ''), count(*) FROM memory_frames GROUP BY 2 UNION ALL
    SELECT 'importance', coalesce(importance, ''), count(*) FROM memory_frames GROUP BY 2""")
def frame_stats(spark, root):
    return op.statistics(frames(spark, root))


@query("SELECT id, content FROM memory_frames WHERE id = 42")
def point_lookup(spark, root):
    return op.by_key(frames(spark, root), "id", 42).select("id", "content")


@query("SELECT id, gop_id, created_at FROM memory_frames ORDER BY id DESC LIMIT 50")
def recent_frames(spark, root):
    return op.recent(frames(spark, root)).select("id", "gop_id", "created_at")


@query("""SELECT id, created_at FROM memory_frames WHERE created_at >= TIMESTAMP '2024-03-01 12:00:00' AND created_at <= TIMESTAMP '2025-02-01 06:30:00'
    ORDER BY id DESC LIMIT 200""")
def recent_filtered(spark, root):
    return op.recent(frames(spark, root), 200, "2024-03-01 12:00:00", "2025-02-01 06:30:00").select("id", "created_at")


@query("SELECT id, created_at FROM memory_frames WHERE created_at::DATE BETWEEN DATE '2024-02-10' AND DATE '2024-11-20'")
def fencepost_window(spark, root):
    return op.within(frames(spark, root), "2024-02-10", "2024-11-20").select("id", "created_at")


@query("SELECT gop_id, id, t FROM memory_frames WHERE frame_type = 'I' QUALIFY row_number() OVER (PARTITION BY gop_id ORDER BY t DESC, id DESC) = 1")
def latest_iframe(spark, root):
    return op.latest_base(frames(spark, root)).select("gop_id", "id", "t")


_BASES = "WITH b AS (SELECT gop_id, id AS base_id, t AS base_t FROM memory_frames WHERE frame_type = 'I' QUALIFY row_number() OVER (PARTITION BY gop_id ORDER BY t DESC, id DESC) = 1)"


@query(_BASES + " SELECT f.gop_id, f.id, f.t, b.base_id AS latest_i FROM memory_frames f JOIN b USING (gop_id) WHERE f.frame_type = 'P' AND f.t > b.base_t")
def pframes_since_i(spark, root):
    return op.deltas_since_base(frames(spark, root)).select("gop_id", "id", "t", "latest_i")


@query(_BASES + """ SELECT b.gop_id, b.base_id, coalesce(string_agg(f.id::VARCHAR, ',' ORDER BY f.t, f.id), '') AS deltas
    FROM b LEFT JOIN memory_frames f ON f.gop_id = b.gop_id AND f.frame_type = 'P' AND f.t > b.base_t GROUP BY 1, 2""")
def reconstruct_state(spark, root):
    return op.state(frames(spark, root)).select("gop_id", "base_id", F.array_join(F.col("delta_ids").cast("array<string>"), ",").alias("deltas"))


@query("SELECT gop_id, coalesce(max(t), -1) + 1 AS next_t FROM memory_frames GROUP BY 1")
def next_t(spark, root):
    return op.next_t(frames(spark, root))


@query("""SELECT id, concat_ws(',', CASE WHEN frame_type IS NULL OR frame_type NOT IN ('I', 'P', 'B') THEN 'frame_type' END,
    CASE WHEN importance IS NULL OR importance NOT IN ('critical', 'important', 'normal', 'temporary', 'deprecated') THEN 'importance' END) AS broken
    FROM (SELECT id, frame_type, CASE WHEN id % 17 = 0 THEN 'urgent' ELSE importance END AS importance FROM memory_frames) WHERE broken <> ''""")
def enum_violations(spark, root):
    changed = frames(spark, root).withColumn("importance", F.when(F.col("id") % 17 == 0, "urgent").otherwise(F.col("importance")))
    return op.invalid(changed)


@query(f"""WITH s AS (SELECT {body_hash('content')} AS h, max(id) AS stored_id FROM memory_frames GROUP BY 1),
    g AS (SELECT {body_hash('content')} AS h, min(id) AS first_id, count(*) AS n FROM raw_archive WHERE erased_at IS NULL GROUP BY 1)
    SELECT CASE WHEN stored_id IS NULL THEN 'insert' ELSE 'touch' END AS action, coalesce(stored_id, first_id) AS frame_id,
    n - CASE WHEN stored_id IS NULL THEN 1 ELSE 0 END AS touches FROM g LEFT JOIN s USING (h) WHERE h IS NOT NULL""")
def content_hash_dedup(spark, root):
    return op.admit(table(spark, root, "raw_archive").filter("erased_at IS NULL").select("id", "content"), frames(spark, root))


@query("""WITH s AS (SELECT user_id + 1 AS frame_id, count(*) AS more, max(ts) AS last_at FROM events GROUP BY 1)
    SELECT id, access_count + coalesce(more, 0) AS access_count, greatest(last_accessed, last_at) AS last_accessed FROM memory_frames LEFT JOIN s ON id = frame_id""")
def touch_counts(spark, root):
    touches = table(spark, root, "events").select((F.col("user_id") + 1).alias("frame_id"), F.lit(1).alias("n"), F.col("ts").alias("at"))
    return op.touched(frames(spark, root), touches)


@query(f"""WITH u AS (SELECT id, CASE WHEN id % 13 = 0 THEN content || ' (revised)' ELSE content END AS content, CASE WHEN id % 26 = 0 THEN 'critical' ELSE importance END AS importance, id % 13 = 0 AS reindex FROM memory_frames)
    SELECT id, importance, {body_hash('content')} AS content_hash, reindex FROM u""")
def update_frames(spark, root):
    f = frames(spark, root)
    changes = f.filter("id % 13 = 0").select("id", F.concat("content", F.lit(" (revised)")).alias("content"), F.when(F.col("id") % 26 == 0, "critical").alias("importance"))
    return op.updated(f, changes).select("id", "importance", "content_hash", "reindex")


@query("""SELECT id, CASE WHEN base_frame_id % 7 = 0 THEN NULL ELSE base_frame_id END AS base_frame_id FROM memory_frames WHERE id % 7 <> 0""")
def delete_cascade(spark, root):
    f = frames(spark, root)
    return op.deleted(f, f.filter("id % 7 = 0").select("id")).select("id", "base_frame_id")


@query(f"""SELECT id, importance FROM memory_frames WHERE (importance = 'temporary' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY)
    OR (importance = 'deprecated' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)""")
def compact_prune(spark, root):
    return op.expired(frames(spark, root), NOW).select("id", "importance")


@query(_BASES + """, p AS (SELECT f.*, b.base_id, count(*) OVER (PARTITION BY f.gop_id) AS n, row_number() OVER (PARTITION BY f.gop_id ORDER BY f.t DESC, f.id DESC) AS back
    FROM memory_frames f JOIN b USING (gop_id) WHERE f.frame_type = 'P' AND f.t > b.base_t)
    SELECT p.gop_id, p.base_id, string_agg(p.id::VARCHAR, ',' ORDER BY p.t, p.id) AS merged, sha256(any_value(m.content) || chr(10) || '---' || chr(10) || string_agg(p.content, chr(10) || '---' || chr(10) ORDER BY p.t, p.id)) AS content_sha
    FROM p JOIN memory_frames m ON m.id = p.base_id WHERE n > 1 AND back > 1 GROUP BY 1, 2""")
def compact_merge(spark, root):
    got = op.merged(frames(spark, root), 1, 1)
    return got.select("gop_id", "base_id", F.array_join(F.col("merged_ids").cast("array<string>"), ",").alias("merged"), F.sha2("content", 256).alias("content_sha"))


@query(_BASES + """ SELECT gop_id, count(*) AS n FROM memory_frames f JOIN b USING (gop_id) WHERE f.frame_type = 'P' AND f.t > b.base_t GROUP BY 1 HAVING count(*) > 1""")
def compact_candidates(spark, root):
    return op.deltas_since_base(frames(spark, root)).groupBy("gop_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT id, importance FROM memory_frames WHERE importance IN ('critical', 'important') ORDER BY importance = 'important', id DESC LIMIT 40""")
def importance_lane(spark, root):
    return op.important_lane(frames(spark, root), 40).select("id", "importance")


@query("SELECT id FROM memory_frames WHERE NOT starts_with(content, '## ')")
def prefix_delete(spark, root):
    return frames(spark, root).filter(~F.col("content").startswith("## ")).select("id")


@query("""SELECT id, created_at FROM memory_frames WHERE contains(lower(content), 'retention') OR contains(lower(content), 'glossary') ORDER BY created_at DESC, id DESC LIMIT 100""")
def like_fallback(spark, root):
    low = F.lower("content")
    return frames(spark, root).filter(low.contains("retention") | low.contains("glossary")).orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "created_at")


@query("SELECT mind, max_by(id, id) AS id, max(id) AS newest FROM memory_frames WHERE importance <> 'deprecated' GROUP BY 1")
def high_signal_preview(spark, root):
    return frames(spark, root).filter("importance <> 'deprecated'").groupBy("mind").agg(F.max_by("id", "id").alias("id"), F.max("id").alias("newest"))


@query("""SELECT mind, count(*) AS frames, count(c.frame_id) AS chunked, round(100.0 * count(c.frame_id) / count(*), 6) AS coverage FROM memory_frames f
    LEFT JOIN (SELECT DISTINCT frame_id FROM frame_chunks) c ON f.id = c.frame_id GROUP BY 1""")
def status_summary(spark, root):
    chunked = table(spark, root, "frame_chunks").select("frame_id").distinct()
    joined = frames(spark, root).join(chunked, F.col("id") == F.col("frame_id"), "left")
    return joined.groupBy("mind").agg(F.count("*").alias("frames"), F.count("frame_id").alias("chunked")).withColumn("coverage", F.round(F.col("chunked") * 100.0 / F.col("frames"), 6).cast("double"))


@query("SELECT id FROM memory_frames f WHERE length(content) > 1500 AND NOT EXISTS (SELECT 1 FROM frame_chunks c WHERE c.frame_id = f.id)")
def reconcile_missing(spark, root):
    long = frames(spark, root).filter(F.length("content") > 1500).select("id")
    return long.join(table(spark, root, "frame_chunks").select(F.col("frame_id").alias("id")), "id", "left_anti")


@query("SELECT chunk_id, frame_id FROM frame_chunks c WHERE NOT EXISTS (SELECT 1 FROM memory_frames f WHERE f.id = c.frame_id AND f.id % 5 <> 0)")
def reconcile_orphans(spark, root):
    left = frames(spark, root).filter("id % 5 <> 0").select(F.col("id").alias("frame_id"))
    return table(spark, root, "frame_chunks").join(left, "frame_id", "left_anti").select("chunk_id", "frame_id")


@query(f"SELECT id, content_hash AS stored, {body_hash('content')} AS computed FROM memory_frames WHERE content_hash IS NULL OR content_hash <> {body_hash('content')}")
def rehash_backfill(spark, root):
    from lodestrata.functions.text import frame_hash

    hashed = frames(spark, root).select("id", F.col("content_hash").alias("stored"), frame_hash(F.col("content")).alias("computed"))
    return hashed.filter("stored IS NULL OR stored <> computed")


@query("SELECT id, base_frame_id FROM (SELECT f.id, CASE WHEN b.source = 'import' THEN NULL ELSE f.base_frame_id END AS base_frame_id FROM memory_frames f LEFT JOIN memory_frames b ON b.id = f.base_frame_id WHERE f.source IS DISTINCT FROM 'import')")
def wipe_imports(spark, root):
    """What is left when all imported frames are deleted, without references to them."""
    f = frames(spark, root)
    return op.deleted(f, f.filter("source = 'import'").select("id")).select("id", "base_frame_id")


@query("""SELECT gop_id, min(created_at) AS started_at, max(created_at) AS last_at, count(*) AS frames, row_number() OVER (ORDER BY min(created_at) DESC, gop_id) AS nth FROM memory_frames GROUP BY 1
    QUALIFY nth <= 100""")
def sessions_recent(spark, root):
    from pyspark.sql.window import Window

    sessions = frames(spark, root).groupBy("gop_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("last_at"), F.count("*").alias("frames"))
    top = sessions.orderBy(F.desc("started_at"), "gop_id").limit(100)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("started_at"), "gop_id")))


@query("""SELECT id, mind, created_at FROM (SELECT *, row_number() OVER (PARTITION BY mind ORDER BY created_at DESC, id DESC) AS k FROM memory_frames
    WHERE created_at >= TIMESTAMP '2025-06-01' - INTERVAL 7 DAY AND created_at < TIMESTAMP '2025-06-01') WHERE k <= 12""")
def digest_frames(spark, root):
    from pyspark.sql.window import Window

    week = frames(spark, root).filter("created_at >= TIMESTAMP_NTZ '2025-06-01' - INTERVAL 7 DAYS AND created_at < TIMESTAMP_NTZ '2025-06-01'")
    w = Window.partitionBy("mind").orderBy(F.desc("created_at"), F.desc("id"))
    return week.withColumn("k", F.row_number().over(w)).filter("k <= 12").select("id", "mind", "created_at")


@query("""SELECT strftime(created_at, '%G-W%V') AS week, mind, count(*) AS n FROM memory_frames GROUP BY 1, 2""")
def digest_buckets(spark, root):
    week = F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), "created_at").cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear("created_at").cast("string"), 2, "0"))
    return frames(spark, root).groupBy(week.alias("week"), "mind").agg(F.count("*").alias("n"))


@query("""SELECT id, coalesce(json_extract_string(metadata, '$.archiveUids[0]'), json_extract_string(metadata, '$.archiveUid')) AS first_uid FROM memory_frames WHERE metadata IS NOT NULL""")
def archive_uids(spark, root):
    return frames(spark, root).filter("metadata IS NOT NULL").select("id", F.coalesce(F.get_json_object("metadata", "$.archiveUids[0]"), F.get_json_object("metadata", "$.archiveUid")).alias("first_uid"))


@query("""WITH l AS (SELECT id, unnest(list_distinct(list_concat(coalesce(from_json(json_extract(metadata, '$.archiveUids'), '["VARCHAR"]'), []), CASE WHEN json_extract_string(metadata, '$.archiveUid') IS NULL THEN [] ELSE [json_extract_string(metadata, '$.archiveUid')] END))) AS uid
    FROM memory_frames WHERE metadata IS NOT NULL) SELECT l.id AS frame_id, a.id AS archive_id FROM l JOIN raw_archive a ON a.archive_uid = l.uid""")
def archive_links(spark, root):
    uids = F.array_union(F.coalesce(F.from_json(F.get_json_object("metadata", "$.archiveUids"), "array<string>"), F.array().cast("array<string>")), F.array_compact(F.array(F.get_json_object("metadata", "$.archiveUid"))))
    linked = frames(spark, root).select(F.col("id").alias("frame_id"), F.explode(uids).alias("archive_uid"))
    return linked.join(table(spark, root, "raw_archive").select("archive_uid", F.col("id").alias("archive_id")), "archive_uid").select("frame_id", "archive_id")


@query("""SELECT id, metadata AS before, json_merge_patch(coalesce(metadata, '{}'), '{"reviewed": "yes"}') ->> 'reviewed' AS reviewed FROM memory_frames""")
def metadata_merge(spark, root):
    parsed = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(parsed, lambda k, v: k != "reviewed"), F.create_map(F.lit("reviewed"), F.lit("yes")))
    return frames(spark, root).select("id", F.col("metadata").alias("before"), F.element_at(merged, "reviewed").alias("reviewed"))
