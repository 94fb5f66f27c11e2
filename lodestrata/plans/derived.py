"""Queries on recall lanes, derived pages and evaluation, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fixed
from lodestrata.functions.text import TURN_HEADER
from lodestrata.operators import derive, lanes, search
from lodestrata.operators.graph import active, mentions
from lodestrata.plans.frames import frames
from lodestrata.plans.graph import _E, _R, relations, trade_entities
from lodestrata.plans.lifecycle import _AWARE
from lodestrata.plans.search import _FRAMES, _hybrid_sql, asked, bm25_sql, hybrid, memory
from lodestrata.plans.texts import _re
from lodestrata.tables import table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_TURNS = f"t AS (SELECT id, content, created_at, regexp_extract(content, '{TURN_HEADER}', 1) AS conv, try_cast(regexp_extract(content, '{TURN_HEADER}', 2) AS BIGINT) AS turn, regexp_extract(content, '{TURN_HEADER}', 3) AS speaker FROM memory_frames WHERE regexp_matches(content, '{TURN_HEADER}'))"


@query(f"WITH {_TURNS} SELECT id, conv, turn, speaker FROM t")
def turn_frames(spark, root):
    return lanes.turns(frames(spark, root)).select("id", "conv", "turn", "speaker")


#: Messages as turns: the conversation is the item, the turn its index.
_MSG = "t AS (SELECT msg_id AS id, any_value(item_id) AS conv, any_value(msg_idx)::BIGINT AS turn, any_value(text) AS text FROM conversation_messages GROUP BY 1)"


def message_turns(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "conversation_messages").select(F.col("msg_id").alias("id"), F.col("item_id").alias("conv"), F.col("msg_idx").cast("long").alias("turn"), "text").distinct()
    return m.withColumn("created_at", F.col("turn"))


_MSG_KW = bm25_sql("SELECT msg_id AS id, any_value(text) AS text FROM conversation_messages GROUP BY 1", 6) + f", {_MSG}"
_NEAR = """, n AS (SELECT qid, t.conv, t.turn + d AS turn, max(d = 0) AS is_hit FROM kw JOIN t USING (id), (VALUES (-1), (0), (1)) v(d) GROUP BY 1, 2, 3),
    x AS (SELECT n.qid, t.id, t.conv, t.turn, n.is_hit FROM n JOIN t USING (conv, turn))"""


def _message_hits(spark, root, k: int = 6) -> DataFrame:
    return search.bm25(asked(spark, root), message_turns(spark, root).select("id", "text"), k)


@query(_MSG_KW + _NEAR + " SELECT * FROM x")
def neighbour_expand(spark, root):
    t = message_turns(spark, root)
    return lanes.with_neighbours(_message_hits(spark, root).join(t.select("id", "conv", "turn"), "id"), t)


@query(_MSG_KW + _NEAR + " SELECT qid, id, is_hit, row_number() OVER (PARTITION BY qid ORDER BY turn, conv, id) - 1 AS position FROM x")
def raw_detail_lane(spark, root):
    return lanes.raw_detail(_message_hits(spark, root), message_turns(spark, root))


_IMPORTANT = "il AS (SELECT q.qid, id FROM q, (SELECT id FROM memory_frames WHERE importance IN ('critical', 'important') ORDER BY importance = 'important', id DESC LIMIT 5))"


_RECENT = "rl AS (SELECT q.qid, id FROM q, (SELECT id FROM memory_frames ORDER BY created_at DESC, id DESC LIMIT 5))"


@query(_hybrid_sql("balanced", 10) + f", {_IMPORTANT}, {_RECENT}, u AS (SELECT qid, id, 0 AS p, 'semantic' AS lane FROM h UNION ALL SELECT qid, id, 1, 'important' FROM il UNION ALL SELECT qid, id, 2, 'recent' FROM rl) SELECT qid, id, arg_min(lane, p) AS lane FROM u GROUP BY 1, 2")
def merged_lanes(spark, root):
    """Hybrid hits, important frames and the newest, each frame in the first lane that has it."""
    from lodestrata.operators.frames import important_lane
    from lodestrata.plans.search import for_each

    q, kept = asked(spark, root), frames(spark, root)
    important = for_each(q, important_lane(kept, 5), F.desc("id"))
    recent = for_each(q, kept.orderBy(F.desc("created_at"), F.desc("id")).limit(5), F.desc("created_at"), F.desc("id"))
    return lanes.merged_lanes(("semantic", hybrid(spark, root, limit=10)), ("important", important), ("recent", recent))


@query(bm25_sql(_FRAMES, 60) + f""", k AS (SELECT kw.qid, kw.id, row_number() OVER (PARTITION BY kw.qid ORDER BY rank, kw.id) - 1 AS nth FROM kw JOIN memory_frames m ON m.id = kw.id WHERE regexp_matches(content, '{_re(fixed.FAILURE)}') AND NOT regexp_matches(content, '{_re(fixed.RESOLVED)}')
    AND NOT coalesce(importance = 'temporary' AND starts_with(content, '[hm session:'), false)) SELECT * FROM k WHERE nth < 2""")
def failure_recall(spark, root):
    return lanes.failures(search.bm25(asked(spark, root), memory(spark, root), 60), frames(spark, root))


@query(bm25_sql(_FRAMES, 20) + """, k AS (SELECT qid, kw.id, rank, row_number() OVER (PARTITION BY qid, substr(content, 1, 80) ORDER BY rank, kw.id) AS k FROM kw JOIN memory_frames m ON m.id = kw.id), n AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, id) - 1 AS nth FROM k WHERE k = 1)
    SELECT * FROM n WHERE nth < 3""")
def prefix_dedupe(spark, root):
    return lanes.first_by_prefix(search.bm25(asked(spark, root), memory(spark, root), 20), frames(spark, root))


@query("SELECT q.vec_id AS qid, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0 AND round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) >= 0.55")
def semantic_filter(spark, root):
    v = table(spark, root, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"), "label")
    return lanes.verified(q.join(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b"), "label"), "label")).select("qid", "id")


@query(bm25_sql(_FRAMES, 6) + f""", {_AWARE}, l AS (SELECT qid, rank, CASE WHEN length(f) > 240 THEN substr(f, 1, 240) || '…' ELSE f END AS line FROM (SELECT qid, rank, content AS f FROM kw JOIN memory_frames m ON m.id = kw.id)),
    f AS (SELECT qid, '## frames' || chr(10) || '- ' || string_agg(line, chr(10) || '- ' ORDER BY rank) AS text FROM l GROUP BY 1),
    t AS (SELECT content, row_number() OVER (ORDER BY priority DESC, id) AS nth FROM a WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25' QUALIFY nth <= 4), g AS (SELECT '## awareness' || chr(10) || '- ' || string_agg(content, chr(10) || '- ' ORDER BY nth) AS text FROM t)
    SELECT q.qid, concat_ws(chr(10) || chr(10), g.text, f.text) AS context FROM q CROSS JOIN g LEFT JOIN f USING (qid)""")
def compose_context(spark, root):
    from lodestrata.operators import state
    from lodestrata.plans.lifecycle import awareness
    from lodestrata.plans.search import for_each

    q = asked(spark, root)
    hits = search.bm25(q, memory(spark, root), 10).join(frames(spark, root).select("id", "content"), "id")
    top = state.awareness_top(awareness(spark, root), "2024-01-25 00:00:00", 4)
    urgent = for_each(q, top, F.desc("priority"), "id").join(top.select("id", "content"), "id")
    parts = [x.select("qid", F.lit(name).alias("section"), F.col("rank").alias("nth"), "content") for name, x in (("awareness", urgent), ("frames", hits))]
    return lanes.composed(parts[0].unionByName(parts[1]))


_BRIDGE = "b AS (SELECT DISTINCT e.id AS entity_id, f.id AS frame_id FROM memory_frames f JOIN knowledge_entities e ON e.valid_to IS NULL AND length(e.name) >= 3 AND contains(lower(f.content), lower(e.name)))"
_SLUG = "substr(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', ''), 1, 80)"


def _pages_sql(where: str = "") -> str:
    return f"""{_BRIDGE}, l AS (SELECT entity_id, frame_id, substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 200) AS line, row_number() OVER (PARTITION BY entity_id ORDER BY frame_id) AS nth FROM b JOIN memory_frames ON id = frame_id {where}),
    g AS (SELECT entity_id, count(*) AS n_frames, string_agg(line, chr(10) || '- ' ORDER BY nth) FILTER (nth <= 8) AS body FROM l GROUP BY 1 HAVING count(*) >= 2),
    pg AS (SELECT {_SLUG} AS slug, name, n_frames, '# ' || name || chr(10) || chr(10) || '- ' || body AS markdown FROM g JOIN knowledge_entities e ON e.id = entity_id WHERE {_SLUG} <> '' QUALIFY row_number() OVER (PARTITION BY {_SLUG} ORDER BY entity_id) = 1)"""


def bridge(spark, root) -> DataFrame:
    e = active(table(spark, root, "knowledge_entities"))
    hits = mentions(frames(spark, root).select("id", F.col("content").alias("text")), e.select("name"))
    return hits.join(e.select(F.col("id").alias("entity_id"), F.lower("name").alias("name")), "name").select("entity_id", F.col("id").alias("frame_id")).distinct()


@query(f"WITH {_pages_sql()} SELECT slug, name, n_frames, substr(sha256(markdown), 1, 16) AS content_hash FROM pg")
def wiki_entity_pages(spark, root):
    return derive.entity_pages(bridge(spark, root), table(spark, root, "knowledge_entities"), frames(spark, root)).select("slug", "name", "n_frames", "content_hash")


_OLD = _pages_sql("WHERE frame_id <= 400")
for _a, _b in (("pg AS (SELECT", "old AS (SELECT"), (" g AS (SELECT", " g0 AS (SELECT"), ("FROM g JOIN", "FROM g0 JOIN"), (", l AS (", ", l0 AS ("), ("FROM l GROUP", "FROM l0 GROUP"), ("b AS (SELECT DISTINCT", "b0 AS (SELECT DISTINCT"), ("FROM b JOIN", "FROM b0 JOIN")):
    _OLD = _OLD.replace(_a, _b)


@query(f"WITH {_pages_sql()}, {_OLD} SELECT coalesce(pg.slug, old.slug) AS slug, CASE WHEN old.slug IS NULL THEN 'created' WHEN pg.slug IS NULL THEN 'stale' WHEN sha256(pg.markdown) = sha256(old.markdown) THEN 'unchanged' ELSE 'updated' END AS action FROM pg FULL JOIN old ON pg.slug = old.slug")
def wiki_upsert_actions(spark, root):
    e, f, b = table(spark, root, "knowledge_entities"), frames(spark, root), bridge(spark, root)
    return derive.page_actions(derive.entity_pages(b, e, f), derive.entity_pages(b.filter("frame_id <= 400"), e, f))


_TRADE_PAGES = "pages AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0)"
_ISSUES = f"""WITH {_R}, {_E}, {_TRADE_PAGES}, d AS (SELECT id, count(*) AS n FROM (SELECT s AS id FROM r UNION ALL SELECT t FROM r) GROUP BY 1), m AS (SELECT e.id, name, coalesce(n, 0) AS n FROM e LEFT JOIN d USING (id)),
    i AS (SELECT 'missing_page' AS kind, name, CASE WHEN n > 2 THEN 'high' ELSE 'low' END AS severity FROM m WHERE n > 0 AND lower(name) NOT IN (SELECT lower(name) FROM pages) UNION ALL
    SELECT 'weak_confidence', s_nationkey::VARCHAR, 'low' FROM supplier GROUP BY s_nationkey HAVING count(*) < 2 UNION ALL SELECT 'orphan_entity', name, 'low' FROM m WHERE n = 0)"""


def _issues(spark, root) -> DataFrame:
    pages = table(spark, root, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    sources = table(spark, root, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("slug")).agg(F.count("*").alias("n_sources"))
    return derive.health(trade_entities(spark, root), pages, relations(spark, root), sources)


@query(_ISSUES + " SELECT * FROM i")
def wiki_health(spark, root):
    return _issues(spark, root)


@query(_ISSUES + """ SELECT count(*) FILTER (kind = 'missing_page') AS missing_page, count(*) FILTER (kind = 'weak_confidence') AS weak_confidence, count(*) FILTER (kind = 'orphan_entity') AS orphan_entity, count(*) FILTER (severity = 'high') AS high,
    (CASE WHEN missing_page = 0 THEN 20 ELSE 0 END + CASE WHEN weak_confidence = 0 THEN 20 ELSE 0 END + CASE WHEN orphan_entity = 0 THEN 20 ELSE 0 END + 40 - least(40, 10 * high))::BIGINT AS score FROM i""")
def wiki_score(spark, root):
    return derive.health_score(_issues(spark, root))


@query("""WITH l AS (SELECT * FROM knowledge_entities WHERE valid_to IS NULL), u AS (SELECT entity_type AS name, count(*) AS n FROM l WHERE entity_type <> 'concept' GROUP BY 1 HAVING count(*) >= 3 UNION ALL SELECT name, count(*) FROM l WHERE entity_type = 'concept' GROUP BY 1)
    SELECT name, sum(n)::BIGINT AS n FROM u GROUP BY 1 ORDER BY n DESC, name LIMIT 20""")
def wiki_concepts(spark, root):
    return derive.concepts(table(spark, root, "knowledge_entities"))


@query("SELECT mind, count(DISTINCT source) AS sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def synthesis_groups(spark, root):
    return table(spark, root, "documents").groupBy("mind").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n")).filter("sources >= 2")


@query(f"WITH {_pages_sql()} SELECT upper(left(name, 1)) AS letter, count(*) AS pages, string_agg(slug, ' ' ORDER BY slug) AS slugs FROM pg GROUP BY 1")
def wiki_index(spark, root):
    pages = derive.entity_pages(bridge(spark, root), table(spark, root, "knowledge_entities"), frames(spark, root))
    return pages.groupBy(F.upper(F.substring("name", 1, 1)).alias("letter")).agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list("slug")), " ").alias("slugs"))


#: A document is right for a title if it is of the same mind and language.
_GOLD = "gold AS (SELECT a.doc_id AS qid, b.doc_id AS id FROM documents a JOIN documents b ON a.mind = b.mind AND a.lang = b.lang WHERE a.doc_id % 100 = 0)"
_DOCS = bm25_sql("SELECT doc_id AS id, text FROM documents", 5)


def _document_hits(spark, root) -> DataFrame:
    return search.bm25(asked(spark, root), table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text"), 5)


def _judged(spark, root, measure) -> DataFrame:
    """The hits by a measure of right ones; pairs of one mind and language are only made of hits."""
    hits = written(_document_hits(spark, root), "hits")
    d = table(spark, root, "documents").select("doc_id", "mind", "lang").filter("mind IS NOT NULL AND lang IS NOT NULL")
    asks = d.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "qid")  # each is right for itself
    right = hits.select("qid", "id").join(asks, "qid").join(d.withColumnRenamed("doc_id", "id"), ["id", "mind", "lang"]).select("qid", "id")
    return measure(hits, right, queries=asks.select("qid").distinct())


@query(_DOCS + f", {_GOLD}, pr AS (SELECT qid, avg(CASE WHEN (qid, id) IN (SELECT (qid, id) FROM gold) THEN 1.0 ELSE 0.0 END) AS pv FROM kw WHERE rank < 3 GROUP BY 1) SELECT qid, round(coalesce(pv, 0.0), 6)::DOUBLE AS precision FROM (SELECT DISTINCT qid FROM gold) LEFT JOIN pr USING (qid)")
def precision_at_3(spark, root):
    return _judged(spark, root, derive.precision_at)


@query(_DOCS + f", {_GOLD} SELECT qid, coalesce(bool_or((qid, id) IN (SELECT (qid, id) FROM gold)), false) AS found FROM (SELECT DISTINCT qid FROM gold) LEFT JOIN kw USING (qid) GROUP BY 1")
def recall_at_5(spark, root):
    return _judged(spark, root, derive.recall_at)


_VOTES = "v AS (SELECT lang, coalesce(n_chars, 0) % 2 = 0 AS j1, coalesce(n_chars, 0) % 3 > 0 AS j2, doc_id % 5 > 0 AS j3 FROM documents)"


def _votes(spark, root) -> DataFrame:
    n = F.coalesce("n_chars", F.lit(0))
    return table(spark, root, "documents").select("lang", (n % 2 == 0).alias("j1"), (n % 3 > 0).alias("j2"), (F.col("doc_id") % 5 > 0).alias("j3"))


@query(f"WITH {_VOTES} SELECT lang, count(*) AS n, round(avg(CASE WHEN j1 AND j2 AND j3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS strict, round(avg(CASE WHEN j1::INT + j2::INT + j3::INT >= 2 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS majority FROM v GROUP BY ROLLUP (lang)")
def judge_rollup(spark, root):
    return derive.judge_rollup(_votes(spark, root), "lang")


@query(f"WITH {_VOTES}, m AS (SELECT avg((j1 = j2)::INT) AS po, avg(j1::INT) AS pa, avg(j2::INT) AS pb FROM v) SELECT 'j1-j2' AS pair, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM m")
def kappa(spark, root):
    return derive.kappa(_votes(spark, root), "j1", "j2")


@query(f"WITH {_VOTES} SELECT count(*) AS n, round(avg(j1::INT), 6) AS share, round((avg(j1::INT) - 0.5) / sqrt(0.5 * 0.5 / count(*)), 6) AS z FROM v")
def z_test(spark, root):
    return derive.z_test(_votes(spark, root), "j1", 0.5)
