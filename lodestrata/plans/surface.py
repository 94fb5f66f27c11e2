"""Queries on the smaller calls of the memory tools, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as fn
from lodestrata.operators import archive as archive_op
from lodestrata.operators import graph
from lodestrata.plans.frames import frames
from lodestrata.plans.graph import _E, _R, relations, trade_entities
from lodestrata.plans.lifecycle import _GONE, _MASTERY, archive, concepts, subjects
from lodestrata.plans.texts import _STRIPPED
from lodestrata.sources.exports import page_items
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


@query(f"""WITH p AS (SELECT doc_id, coalesce(title, 'Web page') AS page, {_STRIPPED} AS plain FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, page, plain AS content, 0 AS section FROM p WHERE length(plain) BETWEEN 50 AND 4000 UNION ALL
    SELECT doc_id, page, trim(part, ' ' || chr(10)), n - 1 FROM (SELECT doc_id, page, unnest(regexp_split_to_array(regexp_replace(plain, '\\n(#{{1,3}}\\s)', chr(1) || '\\1', 'g'), chr(1))) AS part, generate_subscripts(regexp_split_to_array(regexp_replace(plain, '\\n(#{{1,3}}\\s)', chr(1) || '\\1', 'g'), chr(1)), 1) AS n FROM p WHERE length(plain) > 4000) WHERE length(trim(part, ' ' || chr(10))) >= 30)
    SELECT doc_id AS id, section::INT AS section, substr(content, 1, 4000) AS content FROM s""")
def html_sections(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("Web page")).alias("title"), F.col("text").alias("html"))
    return page_items(pages).select("id", "section", "content")


@query("SELECT mind, '{\"frames\":' || count(*) || ',\"important\":' || count(*) FILTER (importance IN ('important', 'critical')) || '}' AS resource FROM memory_frames GROUP BY 1")
def resource_stats(spark, root):
    stats = frames(spark, root).groupBy("mind").agg(F.count("*").alias("frames"), F.sum(F.col("importance").isin("important", "critical").cast("long")).alias("important"))
    return stats.select("mind", F.to_json(F.struct("frames", "important")).alias("resource"))


@query(f"WITH {_MASTERY} SELECT concept, mastery_level FROM m WHERE mastery_level BETWEEN 2 AND 3")
def concepts_between(spark, root):
    return concepts(spark, root).filter("mastery_level BETWEEN 2 AND 3").select("concept", "mastery_level")


@query(_GONE + """ SELECT (SELECT count(*) FROM g) AS frames, (SELECT count(*) FROM frame_chunks WHERE frame_id IN (SELECT id FROM g)) AS chunks,
    (SELECT count(*) FROM raw_archive a WHERE erased_at IS NULL AND EXISTS (SELECT 1 FROM import_items s WHERE s.source = 'cursor' AND s.source = a.source AND s.item_id = a.source_ref)) AS archived""")
def erase_counters(spark, root):
    gone = archive_op.erased_frames(frames(spark, root), archive(spark, root), subjects(spark, root))
    chunks = table(spark, root, "frame_chunks").join(gone.select(F.col("id").alias("frame_id")), "frame_id", "left_semi")
    rows = archive(spark, root).filter("erased_at IS NULL").join(subjects(spark, root), ["source", "source_ref"], "left_semi")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n") for name, df in (("frames", gone), ("chunks", chunks), ("archived", rows))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*(F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("frames", "chunks", "archived")))


@query()
def forbidden_words(spark, root):
    """The words near a prohibition, by archive row."""
    return archive(spark, root).select("id", F.explode(fn.forbidden_words(F.col("content"))).alias("word"))


@query("""WITH s AS (SELECT id, substr(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', ''), 1, 80) AS s FROM raw_archive WHERE title IS NOT NULL), n AS (SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM s)
    SELECT id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS workspace_id FROM n""")
def workspace_ids(spark, root):
    s = archive(spark, root).filter("title IS NOT NULL").select("id", fn.slug(F.col("title")).alias("s"))
    n = s.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("id")))
    return n.select("id", F.when(F.col("n") == 1, F.col("s")).otherwise(F.concat("s", F.lit("-"), F.col("n").cast("string"))).alias("workspace_id"))


@query("""SELECT gop_id, '{"description":"bridge of ' || gop_id || '","references":[' || string_agg(id::VARCHAR, ',' ORDER BY id) || ']}' AS content FROM memory_frames WHERE frame_type = 'I' GROUP BY 1""")
def bridge_frames(spark, root):
    refs = frames(spark, root).filter("frame_type = 'I'").groupBy("gop_id").agg(F.array_sort(F.collect_list("id")).alias("references"))
    return refs.select("gop_id", F.to_json(F.struct(F.concat(F.lit("bridge of "), "gop_id").alias("description"), "references")).alias("content"))


@query("SELECT source, concat_ws(chr(10), 'Name: ' || display_name, 'Zone: ' || home_zone, 'Language: ' || ui_lang) AS context FROM harvest_sources")
def identity_context(spark, root):
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c))
    return table(spark, root, "harvest_sources").select("source", F.concat_ws("\n", part("Name", "display_name"), part("Zone", "home_zone"), part("Language", "ui_lang")).alias("context"))


_NODES = "n AS (SELECT id, name FROM e ORDER BY id LIMIT 60)"


@query(f"WITH {_E}, {_NODES} SELECT * FROM n")
def graph_nodes(spark, root):
    return trade_entities(spark, root).orderBy("id").limit(60).select("id", "name")


@query(f"WITH {_R}, {_E}, {_NODES} SELECT s AS source_id, t AS target_id, k AS relation_type FROM r WHERE vt IS NULL AND s IN (SELECT id FROM n)")
def graph_edges(spark, root):
    nodes = graph_nodes(spark, root).select(F.col("id").alias("source_id"))
    return graph.active(relations(spark, root)).join(nodes, "source_id", "left_semi").select("source_id", "target_id", "relation_type")


@query("SELECT id, name FROM knowledge_entities WHERE valid_to IS NULL AND entity_type = 'organization' AND contains(lower(name), 'in') ORDER BY name, id LIMIT 20")
def search_entities_typed(spark, root):
    e = graph.active(table(spark, root, "knowledge_entities")).filter((F.col("entity_type") == "organization") & F.lower("name").contains("in"))
    return e.orderBy("name", "id").limit(20).select("id", "name")


@query("SELECT id, content_hash FROM memory_frames WHERE id > 200 ORDER BY id LIMIT 100")
def frames_since(spark, root):
    return feeds.after_watermark(frames(spark, root), "id", 200, 100).select("id", "content_hash")


@query("SELECT DISTINCT event_type FROM events")
def stream_dirty_keys(spark, root):
    events = feeds.stream(spark, f"{root}/events.parquet", table(spark, root, "events").schema)
    return feeds.dirty_keys(spark, events, "ts", "event_type", "60 days")
