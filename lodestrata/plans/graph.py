"""Queries on the entity graph and on similarity, with the SQL that checks them.

Relations come from the trade tables: customers placed orders, orders contain
parts, parts are supplied by suppliers, and all of them are located in nations
and regions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fixed
from lodestrata.functions import text as fn
from lodestrata.operators import graph as op
from lodestrata.operators import similarity
from lodestrata.plans.texts import _PROMPT_TOKENS, _re, noisy  # noqa: F401
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


REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = (k * 10**10 for k in range(1, 7))


def relations(spark: SparkSession, root: str) -> DataFrame:
    def edges(t: DataFrame, source, target, kind: str, confidence=None, start=None, end=None) -> DataFrame:
        none = F.lit(None).cast("timestamp_ntz")
        return t.select(source.cast("long").alias("source_id"), target.cast("long").alias("target_id"), F.lit(kind).alias("relation_type"), (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("confidence"), (start if start is not None else none).alias("valid_from"), (end if end is not None else none).alias("valid_to"))

    c = F.col
    orders = table(spark, root, "orders")
    closed = F.when(c("o_orderstatus") == "F", c("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    items = table(spark, root, "lineitem")
    return reduce(
        DataFrame.unionByName,
        [
            edges(table(spark, root, "nation"), c("n_nationkey") + NATION, c("n_regionkey") + REGION, "located_in"),
            edges(table(spark, root, "customer"), c("c_custkey") + CUSTOMER, c("c_nationkey") + NATION, "located_in"),
            edges(table(spark, root, "supplier"), c("s_suppkey") + SUPPLIER, c("s_nationkey") + NATION, "located_in"),
            edges(orders, c("o_custkey") + CUSTOMER, c("o_orderkey") + ORDER, "placed", None, c("o_orderdate"), closed),
            edges(items, c("l_orderkey") + ORDER, c("l_partkey") + PART, "contains", 1 - c("l_discount")),
            edges(items.select("l_partkey", "l_suppkey").distinct(), c("l_partkey") + PART, c("l_suppkey") + SUPPLIER, "supplied_by"),
        ],
    )


_R = f"""r AS (SELECT n_nationkey + {NATION} AS s, n_regionkey + {REGION} AS t, 'located_in' AS k, NULL::TIMESTAMP AS vf, NULL::TIMESTAMP AS vt FROM nation UNION ALL
    SELECT c_custkey + {CUSTOMER}, c_nationkey + {NATION}, 'located_in', NULL, NULL FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + {NATION}, 'located_in', NULL, NULL FROM supplier UNION ALL
    SELECT o_custkey + {CUSTOMER}, o_orderkey + {ORDER}, 'placed', o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END FROM orders UNION ALL
    SELECT l_orderkey + {ORDER}, l_partkey + {PART}, 'contains', NULL, NULL FROM lineitem UNION ALL SELECT DISTINCT l_partkey + {PART}, l_suppkey + {SUPPLIER}, 'supplied_by', NULL::TIMESTAMP, NULL::TIMESTAMP FROM lineitem)"""


def seeds(spark, root) -> DataFrame:
    return table(spark, root, "customer").filter("c_custkey % 100 = 0").select((F.col("c_custkey") + CUSTOMER).alias("id"))


def _bfs(kind: str = "", depth: int = 3) -> str:
    where = f"AND k = '{kind}'" if kind else ""
    return f"""WITH RECURSIVE {_R}, e AS (SELECT DISTINCT s, t FROM r WHERE vt IS NULL {where}),
    b(seed, node, distance) AS (SELECT c_custkey + {CUSTOMER}, c_custkey + {CUSTOMER}, 0 FROM customer WHERE c_custkey % 100 = 0 UNION SELECT seed, t, distance + 1 FROM b JOIN e ON e.s = b.node WHERE distance < {depth}),
    m AS (SELECT seed, node, min(distance) AS distance FROM b GROUP BY 1, 2)"""


@query(_bfs() + " SELECT * FROM m")
def kg_bfs(spark, root):
    return op.reach(relations(spark, root), seeds(spark, root))


@query(_bfs("located_in") + " SELECT * FROM m WHERE distance > 0")
def kg_traverse(spark, root):
    return op.reach(relations(spark, root), seeds(spark, root), 3, "located_in").filter("distance > 0")


@query(_bfs() + f", br AS (SELECT DISTINCT l_orderkey AS frame_id, l_partkey + {PART} AS node FROM lineitem) SELECT seed, frame_id, min(distance) AS distance FROM m JOIN br USING (node) GROUP BY 1, 2")
def frame_distances(spark, root):
    bridge = table(spark, root, "lineitem").select((F.col("l_partkey") + PART).alias("entity_id"), F.col("l_orderkey").alias("frame_id")).distinct()
    return op.frame_distances(op.reach(relations(spark, root), seeds(spark, root)), bridge)


@query(f"WITH {_R} SELECT id, count(*) AS degree FROM (SELECT s AS id FROM r WHERE vt IS NULL UNION ALL SELECT t FROM r WHERE vt IS NULL) GROUP BY 1")
def degree(spark, root):
    return op.degrees(relations(spark, root))


def trade_entities(spark, root) -> DataFrame:
    c = F.col
    none = F.lit(None).cast("timestamp_ntz")
    named = [("customer", c("c_custkey") + CUSTOMER, c("c_name")), ("supplier", c("s_suppkey") + SUPPLIER, c("s_name")), ("part", c("p_partkey") + PART, c("p_name")), ("nation", c("n_nationkey") + NATION, c("n_name")), ("region", c("r_regionkey") + REGION, c("r_name"))]
    return reduce(DataFrame.unionByName, [table(spark, root, t).select(i.cast("long").alias("id"), F.lit(t).alias("entity_type"), n.alias("name"), none.alias("valid_from"), none.alias("valid_to")) for t, i, n in named])


_E = f"""e AS (SELECT c_custkey + {CUSTOMER} AS id, 'customer' AS entity_type, c_name AS name FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER}, 'supplier', s_name FROM supplier UNION ALL SELECT p_partkey + {PART}, 'part', p_name FROM part
    UNION ALL SELECT n_nationkey + {NATION}, 'nation', n_name FROM nation UNION ALL SELECT r_regionkey + {REGION}, 'region', r_name FROM region)"""


@query(f"WITH {_R}, {_E} SELECT id, entity_type FROM e WHERE id NOT IN (SELECT s FROM r WHERE vt IS NULL AND k <> 'located_in') AND id NOT IN (SELECT t FROM r WHERE vt IS NULL AND k <> 'located_in')")
def orphans(spark, root):
    return op.orphans(trade_entities(spark, root), relations(spark, root).filter("relation_type <> 'located_in'")).select("id", "entity_type")


@query(f"""WITH {_R}, {_E}, p AS (SELECT s AS id, '>' || k || ':' || count(*) AS part FROM r WHERE vt IS NULL GROUP BY s, k UNION ALL SELECT t, '<' || k || ':' || count(*) FROM r WHERE vt IS NULL GROUP BY t, k)
    SELECT e.id, coalesce(string_agg(part, ' ' ORDER BY part), '') AS relations FROM e LEFT JOIN p USING (id) GROUP BY 1""")
def neighbours(spark, root):
    return op.neighbours(trade_entities(spark, root), relations(spark, root))


@query("SELECT entity_type, count(*) AS n FROM knowledge_entities WHERE valid_to IS NULL GROUP BY 1")
def entity_type_counts(spark, root):
    return op.active(table(spark, root, "knowledge_entities")).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("SELECT string_agg(part, ', ' ORDER BY n DESC, part) AS top_types FROM (SELECT coalesce(entity_type, '') || '=' || count(*) AS part, count(*) AS n FROM knowledge_entities WHERE valid_to IS NULL GROUP BY entity_type ORDER BY n DESC, part LIMIT 5)")
def entity_top_types(spark, root):
    counts = entity_type_counts(spark, root).select(F.concat(F.coalesce("entity_type", F.lit("")), F.lit("="), F.col("n").cast("string")).alias("part"), "n")
    top = counts.orderBy(F.desc("n"), "part").limit(5)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "part"))), lambda x: x["part"]), ", ").alias("top_types"))


@query("""WITH t AS (SELECT DISTINCT date_trunc('month', recorded_at) AS moment FROM knowledge_entities WHERE recorded_at IS NOT NULL)
    SELECT moment::TIMESTAMP AS moment, id FROM knowledge_entities JOIN t ON valid_from <= moment AND (valid_to IS NULL OR valid_to > moment)""")
def entities_as_of(spark, root):
    e = table(spark, root, "knowledge_entities")
    months = e.filter("recorded_at IS NOT NULL").select(F.date_trunc("month", "recorded_at").cast("timestamp_ntz").alias("at")).distinct()
    return op.valid_at(e.select("id", "valid_from", "valid_to"), months).select(F.col("at").alias("moment"), "id")


@query("SELECT id, name FROM knowledge_entities WHERE contains(lower(name), 'software') ORDER BY name, id LIMIT 30 OFFSET 5")
def search_entities(spark, root):
    return table(spark, root, "knowledge_entities").filter(F.lower("name").contains("software")).orderBy("name", "id").offset(5).limit(30).select("id", "name")


_KEY = "CASE lower(name) " + " ".join(f"WHEN '{a}' THEN '{g[0]}'" for g in fixed.NAME_ALIASES for a in g) + " ELSE lower(name) END"


@query(f"SELECT {_KEY} AS key, lower(coalesce(entity_type, '')) AS kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM knowledge_entities WHERE valid_to IS NULL AND name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, root):
    return op.duplicate_groups(table(spark, root, "knowledge_entities"))


_PARTS = f"p AS (SELECT p_partkey + {PART} AS id, split_part(p_name, ' ', 1) AS name, 'part' AS kind FROM part)"


def _part_entities(spark, root) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")
    return table(spark, root, "part").select((F.col("p_partkey") + PART).alias("id"), F.lit("part").alias("entity_type"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), none.alias("valid_from"), none.alias("valid_to"))


_SURVIVE = f"""WITH {_R}, {_PARTS}, d AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM r WHERE vt IS NULL UNION ALL SELECT t FROM r WHERE vt IS NULL) GROUP BY 1),
    k AS (SELECT p.id, {_KEY} AS key, coalesce(degree, 0) AS degree FROM p LEFT JOIN d USING (id)),
    f AS (SELECT id, first_value(id) OVER (PARTITION BY key ORDER BY degree DESC, id) AS survivor FROM k WHERE key IN (SELECT key FROM k GROUP BY 1 HAVING count(*) > 1))"""


@query(_SURVIVE + " SELECT * FROM f")
def entity_dedupe(spark, root):
    return op.survivors(_part_entities(spark, root), relations(spark, root))


@query(_SURVIVE + " SELECT DISTINCT coalesce(a.survivor, s) AS source_id, coalesce(b.survivor, t) AS target_id, k AS relation_type FROM r LEFT JOIN f a ON a.id = s LEFT JOIN f b ON b.id = t WHERE vt IS NULL AND coalesce(a.survivor, s) <> coalesce(b.survivor, t)")
def entity_repoint(spark, root):
    return op.repointed(relations(spark, root), op.survivors(_part_entities(spark, root), relations(spark, root)))


@query("""WITH n AS (SELECT id AS entity_id, lower(name) AS name FROM knowledge_entities WHERE valid_to IS NULL AND length(name) >= 3), h AS (SELECT a.id, n.entity_id, n.name FROM raw_archive a JOIN n ON contains(lower(a.content), n.name))
    SELECT id, entity_id, row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, entity_id) - 1 AS rank FROM h QUALIFY rank < 12""")
def entities_in_text(spark, root):
    texts = table(spark, root, "raw_archive").select("id", F.col("content").alias("text"))
    return op.seeds_in_text(texts, table(spark, root, "knowledge_entities"))


@query("""WITH n AS (SELECT id AS entity_id, lower(name) AS name FROM knowledge_entities WHERE valid_to IS NULL AND length(name) >= 3), h AS (SELECT DISTINCT f.id AS frame_id, n.name FROM memory_frames f JOIN n ON contains(lower(f.content), n.name)),
    u AS (SELECT name FROM h GROUP BY 1 HAVING count(*) <= greatest(20, floor(0.4 * (SELECT count(*) FROM memory_frames)))) SELECT DISTINCT entity_id, frame_id FROM h JOIN u USING (name) JOIN n USING (name)""")
def bridge_backfill(spark, root):
    texts = table(spark, root, "memory_frames").select("id", F.col("content").alias("text"))
    return op.bridge(texts, table(spark, root, "knowledge_entities"))


@query(f"""WITH c AS (SELECT id, list_concat(list_filter(regexp_extract_all(content, '\\b([A-Z][a-zA-Z]+(?:\\s+(?:de|of|&)\\s+|\\s+)[A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+)*)\\b', 1), lambda x: length(x) >= 4),
    list_filter(regexp_extract_all(content, '\\b([A-Z][a-zA-Z]{{2,}})\\b', 1), lambda x: NOT ({noisy('x')}))) AS ns FROM memory_frames WHERE id > 300),
    s AS (SELECT name, count(*) AS seen FROM (SELECT DISTINCT id, unnest(ns) AS name FROM c) GROUP BY 1) SELECT s.name, seen, entity_id FROM s LEFT JOIN (SELECT name, min(id) AS entity_id FROM knowledge_entities WHERE valid_to IS NULL GROUP BY 1) k USING (name)""")
def cognify_upsert(spark, root):
    texts = table(spark, root, "memory_frames").select("id", F.col("content").alias("text"))
    return op.cognify(texts, table(spark, root, "knowledge_entities"), 300)


@query("""WITH k AS (SELECT id, lower(entity_type) AS t, coalesce(json_keys(properties), []) AS ks FROM knowledge_entities)
    SELECT id, CASE WHEN t = 'person' AND NOT list_contains(ks, 'mentions') THEN 'mentions' ELSE '' END AS missing, coalesce(list_aggregate(list_sort(list_filter(ks, lambda x: x NOT IN ('mentions', 'lang'))), 'string_agg', ','), '') AS unknown FROM k WHERE missing <> '' OR unknown <> ''""")
def ontology_issues(spark, root):
    return op.broken_properties(table(spark, root, "knowledge_entities"), {"person": ["mentions"]}, ["mentions", "lang"])


_NORM = "trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT id, {_NORM} AS t FROM raw_archive WHERE title IS NOT NULL), h AS (SELECT t, min(id) AS class_id FROM k GROUP BY 1),
    g AS (SELECT DISTINCT class_id, substr(t, i, 3) AS gram FROM (SELECT class_id, t, unnest(range(1, length(t) - 1)) AS i FROM h)), z AS (SELECT class_id, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.class_id < b.class_id GROUP BY 1, 2),
    s AS (SELECT a, b, c::DOUBLE / greatest(x.n, y.n) AS sim FROM p JOIN z x ON x.class_id = a JOIN z y ON y.class_id = b WHERE c::DOUBLE / greatest(x.n, y.n) >= 0.4),
    l AS (SELECT class_id, count(*) FILTER (sim >= 0.75) AS near, count(*) FILTER (sim < 0.75) AS related FROM (SELECT a AS class_id, sim FROM s UNION ALL SELECT b, sim FROM s) GROUP BY 1)
    SELECT k.id, h.class_id, coalesce(near, 0) AS near, coalesce(related, 0) AS related FROM k JOIN h USING (t) LEFT JOIN l USING (class_id)""")
def trigram_near_dups(spark, root):
    return similarity.links_per_text(table(spark, root, "raw_archive").select("id", F.col("title").alias("text")))


_FOLD = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


@query(f"""WITH x AS (SELECT id, coalesce({_FOLD.format(c='content')}, '') AS t FROM raw_archive WHERE run_id % 5 = 0), y AS (SELECT id, {_FOLD.format(c='content')} AS t FROM raw_archive WHERE run_id % 5 <> 0 AND content IS NOT NULL),
    h AS (SELECT t, min(id) AS match_id FROM y WHERE t <> '' GROUP BY 1), n AS (SELECT DISTINCT t FROM x WHERE t <> '' AND t NOT IN (SELECT t FROM h)),
    gx AS (SELECT DISTINCT t, substr(t, i, 3) AS gram FROM (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM n)), gy AS (SELECT DISTINCT match_id, substr(t, i, 3) AS gram FROM (SELECT match_id, t, unnest(range(1, length(t) - 1)) AS i FROM h)),
    zx AS (SELECT t, count(*) AS k FROM gx GROUP BY 1), zy AS (SELECT match_id, count(*) AS k FROM gy GROUP BY 1), c AS (SELECT t, match_id, count(*) AS c FROM gx JOIN gy USING (gram) GROUP BY 1, 2),
    s AS (SELECT t, match_id, c::DOUBLE / greatest(zx.k, zy.k) AS similarity FROM c JOIN zx USING (t) JOIN zy USING (match_id) WHERE c::DOUBLE / greatest(zx.k, zy.k) >= {fixed.NEAR_DUPLICATE} QUALIFY row_number() OVER (PARTITION BY t ORDER BY c::DOUBLE / greatest(zx.k, zy.k) DESC, match_id) = 1),
    m AS (SELECT t, match_id, 1.0::DOUBLE AS similarity FROM h UNION ALL SELECT * FROM s)
    SELECT x.id, CASE WHEN x.t = '' OR match_id IS NOT NULL THEN 'skip' ELSE 'keep' END AS action, match_id, round(similarity, 6) AS similarity FROM x LEFT JOIN m ON m.t = x.t AND x.t <> ''""")
def harvest_dedup(spark, root):
    """The contents of every fifth run as incoming ones, checked against those of all other runs."""
    rows = table(spark, root, "raw_archive").select("id", F.col("content").alias("text"), "run_id")
    return similarity.screened_against(rows.filter("run_id % 5 = 0").drop("run_id"), rows.filter("run_id % 5 <> 0").drop("run_id"))


_RULE_WORDS = f"""list_distinct(list_transform(list_filter(regexp_extract_all(lower({{c}}), '[a-z][a-z-]{{{{3,}}}}'), lambda w: w NOT IN ({", ".join("'" + w + "'" for w in fixed.RULE_STOP_WORDS)})), lambda w:
    CASE WHEN length(w) < 5 THEN w WHEN ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'ing') AND length(w) > 6 THEN left(w, length(w) - 3) WHEN ends_with(w, 'ed') AND length(w) > 5 THEN left(w, length(w) - 2)
    WHEN ends_with(w, 'es') AND length(w) > 5 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND length(w) > 4 AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END))"""


def rule_words(c: str) -> str:
    return _RULE_WORDS.format(c=c).replace("{{", "{").replace("}}", "}")


@query(f"""WITH x AS (SELECT doc_id AS left_id, unnest({rule_words('title')}) AS word FROM documents WHERE doc_id % 100 = 0), y AS (SELECT id AS right_id, unnest({rule_words('content')}) AS word FROM raw_archive WHERE regexp_matches(content, '{_re(fixed.NEGATION)}')),
    m AS (SELECT left_id, right_id, count(*) AS shared FROM x JOIN y USING (word) GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT left_id, right_id, shared, row_number() OVER (PARTITION BY left_id ORDER BY shared DESC, right_id) - 1 AS rank FROM m QUALIFY rank < 3""")
def contradictions(spark, root):
    asked = table(spark, root, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("id"), fn.rule_tokens(F.col("title")).alias("words"))
    rules = table(spark, root, "raw_archive").filter(fn.has_negation(F.col("content"))).select("id", fn.rule_tokens(F.col("content")).alias("words"))
    return similarity.shared_words(asked, rules)


@query(f"""WITH x AS (SELECT msg_id AS left_id, unnest({rule_words('text')}) AS word FROM (SELECT DISTINCT msg_id, text FROM conversation_messages WHERE regexp_matches(text, '{_re(fixed.WHY)}'))), y AS (SELECT id AS right_id, unnest({rule_words('name')}) AS word FROM knowledge_entities WHERE entity_type = 'concept'),
    m AS (SELECT left_id, right_id, count(*) AS shared FROM x JOIN y USING (word) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT left_id, right_id, shared, row_number() OVER (PARTITION BY left_id ORDER BY shared DESC, right_id) - 1 AS rank FROM m QUALIFY rank < 3""")
def decision_matches(spark, root):
    asked = table(spark, root, "conversation_messages").filter(fn.asks_why(F.col("text"))).select(F.col("msg_id").alias("id"), fn.rule_tokens(F.col("text")).alias("words")).distinct()
    concepts = table(spark, root, "knowledge_entities").filter("entity_type = 'concept'").select("id", fn.rule_tokens(F.col("name")).alias("words"))
    return similarity.shared_words(asked, concepts)
