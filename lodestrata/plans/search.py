"""Queries on retrieval, with the SQL that checks them.

The queries asked are all documents or vectors whose id is divisible by 100,
documents by their title, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fixed
from lodestrata.operators import search as op
from lodestrata.operators.pipeline import byte_embedding, embedded
from lodestrata.plans.frames import NOW, frames
from lodestrata.plans.graph import _E, _R, relations, trade_entities
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


def asked(spark: SparkSession, root: str) -> DataFrame:
    """The titles of the documents whose id is divisible by 100."""
    return table(spark, root, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("title", F.substring("text", 1, 80), F.lit("")).alias("text"), "mind")


def memory(spark: SparkSession, root: str) -> DataFrame:
    return frames(spark, root).select("id", F.col("content").alias("text"), "mind", "gop_id")


_STOP = ", ".join(f"'{w}'" for w in fixed.QUERY_STOP_WORDS)
_ASKED = f"""q AS (SELECT doc_id AS qid, coalesce(title, substr(text, 1, 80), '') AS text, mind FROM documents WHERE doc_id % 100 = 0),
qt AS (SELECT DISTINCT qid, mind, lower(w) AS term FROM (SELECT qid, mind, regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '[^A-Za-z0-9_]', '', 'g') AS w FROM q) WHERE length(w) > 2 AND lower(w) NOT IN ({_STOP}))"""
_TEMPLATE = """c AS ({corpus}), tok AS (SELECT id, {group}regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ts FROM c),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM tok),
p AS (SELECT id, {group}len, term, count(*) AS tf FROM (SELECT id, {group}len(ts) AS len, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT p.*, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)) AS w FROM p JOIN d USING (term), s),
sc AS (SELECT qid, id, round(sum(w), 6) AS score FROM qt JOIN w USING (term) {where} GROUP BY 1, 2),
kw AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM sc QUALIFY rank < {k})"""


def bm25_sql(corpus: str, k: int, group: str = "", where: str = "") -> str:
    return "WITH " + _ASKED + ", " + _TEMPLATE.format(corpus=corpus, k=k, group=group, where=where)


_FRAMES = "SELECT id, content AS text, mind FROM memory_frames"
_KW = bm25_sql(_FRAMES, 40)


@query(bm25_sql("SELECT doc_id AS id, text FROM documents", 20) + " SELECT * FROM kw")
def bm25_topk(spark, root):
    corpus = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")
    return op.bm25(asked(spark, root), corpus, 20)


@query(bm25_sql(_FRAMES, 10, "mind, ", "WHERE qt.mind IS NOT DISTINCT FROM w.mind") + " SELECT * FROM kw")
def keyword_scoped(spark, root):
    return op.bm25(asked(spark, root), memory(spark, root), 10, "mind")


def _vectors(spark, root):
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v.filter("id % 100 = 0").withColumnRenamed("id", "qid"), v


_KNN = """SELECT q.vec_id AS qid, v.vec_id AS id, round({d}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({d}, 6), v.vec_id) - 1 AS rank
    FROM embeddings q JOIN embeddings v ON true {where} WHERE q.vec_id % 100 = 0 QUALIFY rank < {k}"""
_L2 = "list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@query(_KNN.format(d=_L2, where="", k=10))
def knn_l2(spark, root):
    return op.nearest(*_vectors(spark, root), 10)


@query(_KNN.format(d="1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])", where="", k=10))
def knn_cosine(spark, root):
    return op.nearest(*_vectors(spark, root), 10, "cosine")


@query(_KNN.format(d=_L2, where="AND q.label = v.label", k=10))
def knn_scoped(spark, root):
    return op.nearest(*_vectors(spark, root), 10, label="label")


def for_each(queries: DataFrame, few: DataFrame, *order) -> DataFrame:
    """qid, id and rank of the ``few`` rows (a limit's worth) for every query: one array, looked up once."""
    from pyspark.sql.window import Window

    ranked = few.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("rows"))
    return queries.withColumn("hit", F.explode(rows.scalar())).select("qid", "hit.id", "hit.rank")


def _vector(c: str) -> str:
    """The first sixteen bytes as byte_embedding gives them."""
    return f"list_transform(range(1, 17), lambda i: CASE WHEN i <= octet_length(encode({c})) THEN ((('0x' || substr(hex(encode({c})), 2 * i::INT - 1, 2))::INT - 128) / 128.0)::DOUBLE ELSE 0::DOUBLE END)"


@query(f"""WITH {_ASKED}, p AS (SELECT chunk_id * 2 AS id, frame_id, text FROM frame_chunks WHERE text IS NOT NULL UNION ALL SELECT id * 2 + 1, id, content FROM memory_frames WHERE content IS NOT NULL AND id NOT IN (SELECT frame_id FROM frame_chunks WHERE text IS NOT NULL AND frame_id IS NOT NULL)),
    pe AS (SELECT id, frame_id, {_vector("text")} AS v FROM p), qe AS (SELECT qid, {_vector("text")} AS v FROM q), h AS (SELECT qid, frame_id, round(list_distance(qe.v, pe.v), 6) AS distance, row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(qe.v, pe.v), 6), id) AS k FROM qe JOIN pe ON true QUALIFY k <= 25),
    m AS (SELECT qid, frame_id, min(distance) AS distance FROM h GROUP BY 1, 2) SELECT qid, frame_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, frame_id) - 1 AS rank FROM m QUALIFY rank < 5""")
def chunk_knn(spark, root):
    """Frames by the nearest of their chunks; a frame without chunks counts as one."""
    embed = byte_embedding(16)
    pieces = table(spark, root, "frame_chunks").filter("text IS NOT NULL").select((F.col("chunk_id") * 2).alias("id"), "frame_id", "text")
    whole = frames(spark, root).filter("content IS NOT NULL").select((F.col("id") * 2 + 1).alias("id"), F.col("id").alias("frame_id"), F.col("content").alias("text")).join(pieces.select("frame_id").distinct(), "frame_id", "left_anti")
    chunks = pieces.unionByName(whole)
    asks = embedded(asked(spark, root).select(F.col("qid").alias("id"), "text"), embed, 16).withColumnRenamed("id", "qid")
    return op.first_per_frame(op.nearest(asks, embedded(chunks.select("id", "text"), embed, 16), 25), chunks, 5)


def _hybrid_sql(profile: str, limit: int = 20, where: str = "true", depth: int | None = None) -> str:
    """The tables of the hybrid search: kw and vl are its lanes, f what fusing them gives, h the result."""
    depth = depth or 2 * limit
    t, p, c, i = fixed.PROFILES[profile]
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.IMPORTANCE_WEIGHTS.items())
    keyword = bm25_sql(f"SELECT id, content AS text FROM memory_frames WHERE {where}", depth).removeprefix("WITH ")
    return f"""WITH RECURSIVE {keyword}, {_R}, {_E}, mf AS (SELECT * FROM memory_frames WHERE {where}),
    ve AS (SELECT id, {_vector("content")} AS v FROM mf WHERE content IS NOT NULL), qe AS (SELECT qid, {_vector("text")} AS v FROM q),
    vl AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(qe.v, ve.v), 6), id) - 1 AS rank FROM qe JOIN ve ON true QUALIFY rank < {depth}),
    f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT qid, id, rank FROM kw UNION ALL SELECT qid, id, rank FROM vl) GROUP BY 1, 2),
    ke AS (SELECT id, lower(name) AS name FROM (SELECT id, name FROM knowledge_entities WHERE valid_to IS NULL UNION ALL SELECT id, name FROM e) WHERE length(lower(name)) >= 3),
    sd AS (SELECT q.qid, ke.id AS seed, row_number() OVER (PARTITION BY q.qid ORDER BY length(ke.name) DESC, ke.id) AS k FROM q JOIN ke ON contains(lower(q.text), ke.name) QUALIFY k <= 12),
    ed AS (SELECT DISTINCT s, t FROM r WHERE vt IS NULL), b(seed, node, distance) AS (SELECT DISTINCT seed, seed, 0 FROM sd UNION SELECT seed, ed.t, distance + 1 FROM b JOIN ed ON ed.s = b.node WHERE distance < 3),
    hn AS (SELECT DISTINCT mf.id, ke.name FROM mf JOIN ke ON contains(lower(mf.content), ke.name)), un AS (SELECT name FROM hn GROUP BY 1 HAVING count(*) <= greatest(20, floor(0.4 * (SELECT count(*) FROM mf)))),
    br AS (SELECT DISTINCT hn.id, ke.id AS node FROM hn JOIN un USING (name) JOIN ke USING (name)), gd AS (SELECT sd.qid, br.id, min(distance) AS distance FROM sd JOIN b USING (seed) JOIN br USING (node) GROUP BY 1, 2),
    a AS (SELECT f.*, distance, access_count, importance, epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(m.created_at, m.last_accessed)) AS us FROM f JOIN mf m ON m.id = f.id LEFT JOIN gd ON gd.qid = f.qid AND gd.id = f.id),
    x AS (SELECT qid, id, rrf, {t} * (CASE WHEN us / 86400000000.0 <= 7 THEN 1.0 ELSE pow(0.5::DOUBLE, us / 86400000000.0 / 30) END) + {p} * (1 + 0.1 * log10(1 + coalesce(access_count, 0)))
        + {c} * (CASE distance WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.2 ELSE 0.0 END)::DOUBLE + {i} * coalesce(CASE importance {weights} END, 1.0)::DOUBLE AS rel FROM a),
    h AS (SELECT qid, id, round(rrf, 6) AS rrf, round(rel, 6)::DOUBLE AS relevance, round(rrf * rel, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(rrf * rel, 6) DESC, id) - 1 AS rank FROM x QUALIFY rank < {limit})"""


def hybrid(spark, root, profile: str = "balanced", limit: int = 20, kept: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """The hybrid search: keyword and vector lanes per query, graph context over all entities there are."""
    known = table(spark, root, "knowledge_entities")
    own = trade_entities(spark, root)
    entities = known.select(*own.columns).unionByName(own)
    return op.hybrid(asked(spark, root), frames(spark, root) if kept is None else kept, NOW, byte_embedding(16), 16, entities, relations(spark, root), profile, limit, depth)


def _register(profile: str) -> None:
    QUERIES[f"hybrid_{profile}"] = lambda spark, root: hybrid(spark, root, profile)
    SQL[f"hybrid_{profile}"] = _hybrid_sql(profile) + " SELECT * FROM h"


for _profile in fixed.PROFILES:
    _register(_profile)


@query(_hybrid_sql("balanced") + " SELECT qid, id, round(rrf, 6) AS rrf FROM f")
def rrf_fusion(spark, root):
    """Both lanes fused, before scoring."""
    q, corpus = asked(spark, root), memory(spark, root)
    return op.fuse(op.bm25(q, corpus, 40), op.vector_lane(q, corpus, byte_embedding(16), 16, 40)).select("qid", "id", F.round("rrf", 6).alias("rrf"))


@query(_hybrid_sql("balanced", where="created_at >= TIMESTAMP '2024-03-01' AND created_at < TIMESTAMP '2024-07-01'", depth=200) + " SELECT * FROM h")
def hybrid_windowed(spark, root):
    """With a window in time each lane brings ten times the limit."""
    from lodestrata.operators.frames import within

    return hybrid(spark, root, kept=within(frames(spark, root), "2024-03-01", "2024-06-30"), depth=200)


@query(_hybrid_sql("balanced") + " SELECT q.qid, max(score) AS best, coalesce(max(score) > 0.02, false) AS sufficient FROM q LEFT JOIN h USING (qid) GROUP BY 1")
def confidence_gate(spark, root):
    return op.sure(hybrid(spark, root), asked(spark, root), 0.02)


_OVERLAP = """(SELECT qid, h.id, h.rank, CASE WHEN (SELECT count(*) FROM qt WHERE qt.qid = h.qid) = 0 THEN 0.0::DOUBLE ELSE round((SELECT count(*) FROM qt WHERE qt.qid = h.qid AND list_contains(tok.ts, qt.term))::DOUBLE / (SELECT count(*) FROM qt WHERE qt.qid = h.qid), 6) END AS score FROM h JOIN tok USING (id) WHERE h.rank < {pool})"""


@query(_hybrid_sql("balanced", 40) + f""", y AS (SELECT qid, id, rank AS r0, 'reranked' AS kind, score FROM {_OVERLAP.format(pool=30)} UNION ALL SELECT qid, id, rank, 'fused', score FROM h WHERE rank >= 30)
    SELECT qid, id, kind, score, row_number() OVER (PARTITION BY qid ORDER BY kind DESC, CASE WHEN kind = 'reranked' THEN score END DESC, r0) - 1 AS rank FROM y""")
def rerank_pool(spark, root):
    return op.rerank(hybrid(spark, root, limit=40), asked(spark, root), memory(spark, root))


@query(bm25_sql(_FRAMES, 60) + """, m AS (SELECT kw.qid, kw.id, kw.score, mf.mind, row_number() OVER (PARTITION BY qid, mf.mind ORDER BY score DESC, kw.id) - 1 AS k FROM kw JOIN memory_frames mf ON mf.id = kw.id),
    r AS (SELECT qid, id, mind, round(floor(score * 1000 + 0.5) / 1000, 3) AS score FROM m WHERE k < 5)
    SELECT qid, id, mind, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM r QUALIFY rank < 5""")
def federated_recall(spark, root):
    hits = op.bm25(asked(spark, root), memory(spark, root), 60).drop("rank").join(memory(spark, root).select("id", "mind"), "id")
    return op.federated(hits, 5).select("qid", "id", "mind", "score", "rank")


@query(bm25_sql(_FRAMES, 20) + """, j AS (SELECT kw.qid, kw.id, score, coalesce(mf.mind = q.mind, false) AS inside FROM kw JOIN memory_frames mf ON mf.id = kw.id JOIN q ON q.qid = kw.qid),
    o AS (SELECT qid, id, inside, CASE WHEN inside THEN score ELSE score * 0.5 END AS score, row_number() OVER (PARTITION BY qid, inside ORDER BY score DESC, id) AS k FROM j)
    SELECT qid, id, inside, score FROM o WHERE inside OR k <= 2""")
def cross_project_split(spark, root):
    hits = op.bm25(asked(spark, root), memory(spark, root), 20).drop("rank")
    own = hits.join(memory(spark, root).select("id", "mind"), "id").join(asked(spark, root).select("qid", F.col("mind").alias("q_mind")), "qid")
    marked = own.withColumn("inside", F.coalesce(F.col("mind") == F.col("q_mind"), F.lit(False)))
    ranked = op.top_k(marked, 1 << 30, ["qid", "inside"], F.desc("score"), "id").filter(F.col("inside") | (F.col("rank") < 2))
    return ranked.select("qid", "id", "inside", F.when(F.col("inside"), F.col("score")).otherwise(F.col("score") * 0.5).alias("score"))
