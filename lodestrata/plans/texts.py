"""Queries that apply the text and date functions to whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dates, fixed
from lodestrata.functions import text as fn
from lodestrata.plans.frames import body_hash
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


def messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversation_messages")


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _re(patterns) -> str:
    return fixed.any_of(patterns).replace("'", "''")


@query(f"SELECT id, {body_hash('content')} AS body_sha, sha256(coalesce(source, '') || chr(0) || coalesce(source_ref, '') || chr(0) || coalesce(content, '')) AS uid, substr(sha256(coalesce(source, '') || chr(0) || coalesce(source_ref, '')), 1, 40) AS stable, substr(sha256('claude-code' || chr(0) || 'decision-of' || chr(0) || archive_uid), 1, 40) AS decision, substr(sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))), 1, 16) AS near FROM raw_archive")
def stable_ids(spark, root):
    c = F.col
    return archive(spark, root).select("id", fn.frame_hash(c("content")).alias("body_sha"), fn.archive_uid(c("source"), c("source_ref"), c("content")).alias("uid"), fn.stable_id(c("source"), c("source_ref")).alias("stable"), fn.decision_id(c("archive_uid")).alias("decision"), fn.short_hash(fn.normalized(c("content"))).alias("near"))


@query("WITH h AS (SELECT source, substr(sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))), 1, 16) AS h FROM raw_archive) SELECT source, substr(sha256(string_agg(h, '' ORDER BY h)), 1, 32) AS set_hash FROM h GROUP BY 1")
def harvest_set_hash(spark, root):
    hashed = archive(spark, root).select("source", fn.short_hash(fn.normalized(F.col("content"))).alias("h"))
    return hashed.groupBy("source").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256), 1, 32).alias("set_hash"))


@query("SELECT id, substr(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', ''), 1, 80) AS slug FROM raw_archive WHERE title IS NOT NULL")
def slugs(spark, root):
    return archive(spark, root).filter("title IS NOT NULL").select("id", fn.slug(F.col("title")).alias("slug"))


@query("""SELECT source, source_path, CASE WHEN source_path IS NULL OR clean IN ('', '/home/me') THEN 'personal' ELSE 'proj-' || substr(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(clean, '([^/]+)$', 1)), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', ''), 1, 80) END AS workspace
    FROM (SELECT *, regexp_replace(replace(source_path, chr(92), '/'), '/+$', '') AS clean FROM harvest_sources)""")
def workspaces(spark, root):
    return table(spark, root, "harvest_sources").select("source", "source_path", fn.workspace_of(F.col("source_path"), "/home/me").alias("workspace"))


_ALIAS = " ".join(f"WHEN '{a}' THEN '{g[0]}'" for g in fixed.NAME_ALIASES for a in g)
_NOISY = f"""CASE WHEN coalesce({{n}}, '') = '' THEN true WHEN lower({{n}}) IN ({_quoted(fixed.TECH_NAMES)}) THEN false WHEN length({{n}}) < 4 THEN true WHEN {{n}} IN ({_quoted(fixed.STOP_TOKENS)}) THEN true
    ELSE NOT regexp_matches({{n}}, '\\s') AND regexp_matches({{n}}, '^[A-Z]{{{{1,6}}}}$') END"""


def noisy(name: str) -> str:
    return _NOISY.format(n=name).replace("{{", "{").replace("}}", "}")


@query(f"""SELECT id, CASE lower(name) {_ALIAS} ELSE lower(name) END AS key, {noisy('name')} AS is_noise,
    length(trim(lower(name))) <= 2 OR trim(lower(name)) IN ({_quoted(fixed.NOISE_NAMES)}) OR regexp_matches(trim(lower(name)), '^\\d+$')
    OR coalesce(entity_type = 'person' AND (regexp_matches(trim(lower(name)), '^(step|phase|part|section|item|task|bug|fix|test)\\b') OR regexp_matches(trim(lower(name)), '^(the|a|an|this|that|my|your)\\s')), false) AS is_noise_entity FROM knowledge_entities""")
def noise_filter(spark, root):
    n = F.col("name")
    return table(spark, root, "knowledge_entities").select("id", fn.entity_key(n).alias("key"), fn.is_noise_name(n).alias("is_noise"), fn.is_noise_entity(n, F.col("entity_type")).alias("is_noise_entity"))


@query(f"""WITH c AS (SELECT id, list_concat(list_filter(regexp_extract_all(content, '\\b([A-Z][a-zA-Z]+(?:\\s+(?:de|of|&)\\s+|\\s+)[A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+)*)\\b', 1), lambda x: length(x) >= 4),
    list_filter(regexp_extract_all(content, '\\b([A-Z][a-zA-Z]{{2,}})\\b', 1), lambda x: NOT ({noisy('x')}))) AS all_names FROM raw_archive WHERE content IS NOT NULL)
    SELECT DISTINCT id, unnest(all_names) AS name FROM c""")
def entity_extract(spark, root):
    return archive(spark, root).filter("content IS NOT NULL").select("id", F.explode(fn.candidate_entities(F.col("content"))).alias("name"))


_INJECTION = f"""SELECT {{key}} AS id, CASE WHEN regexp_matches({{c}}, '{_re(fixed.ROLE_OVERRIDE)}') THEN 0.5 ELSE 0.0 END AS a, CASE WHEN regexp_matches({{c}}, '{_re(fixed.PROMPT_EXTRACTION)}') THEN 0.4 ELSE 0.0 END AS b,
    CASE WHEN regexp_matches({{c}}, '{_re(fixed.INSTRUCTION_INJECTION)}') THEN 0.3 ELSE 0.0 END AS d FROM {{t}} WHERE {{c}} IS NOT NULL"""


@query("WITH f AS (" + _INJECTION.replace("{{", "{").replace("}}", "}").replace("{key}", "id").replace("{c}", "content").replace("{t}", "raw_archive") + """)
    SELECT id, least(1.0, a + b + d)::DOUBLE AS score, least(1.0, a + b + d) < 0.3 AS safe, concat_ws(',', CASE WHEN a > 0 THEN 'role_override' END, CASE WHEN b > 0 THEN 'prompt_extraction' END, CASE WHEN d > 0 THEN 'instruction_injection' END) AS flags FROM f""")
def injection_scan(spark, root):
    scan = archive(spark, root).filter("content IS NOT NULL").select("id", fn.injection(F.col("content"), F.lit("user_input")).alias("x"))
    return scan.select("id", F.round("x.score", 6).alias("score"), "x.safe", F.array_join("x.flags", ",").alias("flags"))


@query(f"""SELECT msg_id, coalesce(regexp_matches(text, '{_re(fixed.NEGATION)}'), false) AS negated, coalesce(regexp_matches(text, '{_re(fixed.WHY)}'), false) AS why,
    coalesce(regexp_matches(text, '{_re(fixed.FAILURE)}') AND NOT regexp_matches(text, '{_re(fixed.RESOLVED)}'), false) AS failed, coalesce(regexp_matches(text, '{fixed.BOOKKEEPING}'), false) AS books FROM conversation_messages""")
def message_intents(spark, root):
    t = F.col("text")
    return messages(spark, root).select("msg_id", fn.has_negation(t).alias("negated"), fn.asks_why(t).alias("why"), fn.reports_failure(t).alias("failed"), fn.is_bookkeeping(t).alias("books"))


_PROMPT_TOKENS = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_quoted(fixed.PROMPT_STOP_WORDS)}))"


@query(f"""WITH t AS (SELECT DISTINCT msg_id, mind, {_PROMPT_TOKENS} AS ws FROM conversation_messages WHERE text IS NOT NULL),
    u AS (SELECT msg_id, mind, w, max(k) AS k FROM (SELECT msg_id, mind, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM t) GROUP BY ALL), l AS (SELECT msg_id, mind, w, k FROM u QUALIFY row_number() OVER (PARTITION BY msg_id, mind ORDER BY k DESC) <= 3)
    SELECT t.msg_id, coalesce(nullif(substr(concat_ws(' ', t.mind, string_agg(l.w, ' ' ORDER BY l.k)), 1, 200), ''), 'recent work') AS recall FROM t LEFT JOIN l USING (msg_id) GROUP BY t.msg_id, t.mind""")
def recall_queries(spark, root):
    words = fn.last_unique(fn.prompt_tokens(F.col("text")), 3)
    built = messages(spark, root).filter("text IS NOT NULL").select("msg_id", "mind", "text").distinct()
    joined = F.concat_ws(" ", "mind", F.nullif(F.array_join(words, " "), F.lit("")))
    return built.select("msg_id", F.coalesce(F.nullif(F.substring(joined, 1, 200), F.lit("")), F.lit("recent work")).alias("recall"))


@query(r"""SELECT id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(content, '\*\*([^*]+)\*\*', 1), lambda t: trim(t)), lambda t: length(t) > 1 AND length(t) < 80))) AS term FROM raw_archive""")
def bold_terms(spark, root):
    return archive(spark, root).select("id", F.explode(fn.bold_terms(F.col("content"))).alias("term"))


@query(r"""SELECT id, CASE WHEN length(f) > 80 THEN substr(f, 1, 79) || '…' ELSE f END AS preview, length(substr(content, 1, 6000)) AS embedded FROM (SELECT id, content, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM memory_frames)""")
def previews(spark, root):
    c = F.col("content")
    return table(spark, root, "memory_frames").select("id", fn.preview(c, 80).alias("preview"), F.length(fn.capped(c, F.lit("small"))).cast("long").alias("embedded"))


@query(r"""SELECT doc_id, CASE WHEN starts_with(b, 'http://') OR starts_with(b, 'https://') THEN 'url' WHEN p AND ends_with(lower(b), '.pdf') THEN 'pdf' WHEN p AND (ends_with(lower(b), '.md') OR ends_with(lower(b), '.markdown')) THEN 'markdown'
    WHEN p AND ends_with(lower(b), '.txt') THEN 'plaintext' WHEN starts_with(b, '#') OR contains(b, chr(10) || '## ') OR contains(b, chr(10) || '### ') THEN 'markdown' ELSE 'plaintext' END AS kind
    FROM (SELECT doc_id, trim(text) AS b, length(trim(text)) < 500 AND NOT contains(trim(text), chr(10)) AS p FROM documents WHERE text IS NOT NULL)""")
def content_types(spark, root):
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", fn.content_type(F.col("text")).alias("kind"))


_STRIPPED = "text"
for _tag in ("script", "style", "nav", "footer", "header"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}.*?</{_tag}>', '', 'g')"
for _n in (1, 2, 3):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<h{_n}[^>]*>(.*?)</h{_n}>', chr(10) || '{'#' * _n} \\1' || chr(10), 'g')"
for _p, _by in ((r"(?i)</p>", "chr(10) || chr(10)"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)<li[^>]*>", "chr(10) || '- '"), (r"<[^>]+>", "''")):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_p}', {_by}, 'g')"
for _e, _by in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _STRIPPED = f"replace({_STRIPPED}, '{_e}', '{_by}')"
_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '')"


@query(f"SELECT doc_id, {_STRIPPED} AS plain FROM documents WHERE text IS NOT NULL")
def html_strip(spark, root):
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", fn.strip_html(F.col("text")).alias("plain"))


@query("""WITH p AS (SELECT doc_id, '<html><head><title> Page  ' || doc_id || chr(10) || coalesce(title, '') || '</title><meta name="description" content="about ' || coalesce(lang, 'all') || '"></head>' AS html FROM documents)
    SELECT doc_id, regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\\s+', ' ', 'g') AS title, 'about ' || regexp_extract(html, 'content="about ([^"]*)"', 1) AS description FROM p""")
def html_title(spark, root):
    html = F.concat(F.lit("<html><head><title> Page  "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("title", F.lit("")), F.lit('</title><meta name="description" content="about '), F.coalesce("lang", F.lit("all")), F.lit('"></head>'))
    return table(spark, root, "documents").select("doc_id", fn.html_title(html).alias("title"), fn.html_description(html).alias("description"))


@query(r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?m)^#{1,3}\s')) AS part, generate_subscripts(regexp_split_to_array(text, '(?m)^#{1,3}\s'), 1) AS n FROM documents WHERE regexp_matches(text, '(?m)^#{1,3}\s'))
    SELECT doc_id, n - 1 AS section, substr(part, 1, 4000) AS content FROM s WHERE trim(part) <> ''""")
def md_sections(spark, root):
    parts = F.split("text", r"(?m)^#{1,3}\s")
    cut = table(spark, root, "documents").filter(F.col("text").rlike(r"(?m)^#{1,3}\s")).select("doc_id", F.posexplode(parts).alias("section", "part"))
    return cut.filter(F.trim("part") != "").select("doc_id", F.col("section").cast("long").alias("section"), F.substring("part", 1, 4000).alias("content"))


@query()
def plaintext_chunks(spark, root):
    packed = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(fn.pack_paragraphs(F.col("text"))).alias("part", "content"))
    return packed.select("doc_id", "part", F.substring("content", 1, 4000).alias("content"))


_M = "(january|february|march|april|may|june|july|august|september|october|november|december)"
_MN = "list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], {})"
_QUESTIONS = [
    "What did we ship in the first week of march 2024?", "the last week of February 2024 was odd", "plans for early june 2025", "late february 2023 costs", "mid May 2025", "what about the 14th of March 2024", "notes from june 3, 2024",
    "what happened in april 2025", "everything in 2024", "during 2023 please", "no date here", "the fourth week of february 2023", "on 30 january 2024",
]


def _asked_dates(spark):
    return spark.createDataFrame(list(enumerate(_QUESTIONS)), "qid long, text string")


_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_QUESTIONS))


@query(f"""WITH q AS (SELECT qid, lower(t) AS t FROM (VALUES {_VALUES}) v(qid, t)),
    a AS (SELECT qid, t, regexp_extract(t, '(first|second|third|fourth|last)\\s+week\\s+of\\s+{_M}\\s+(\\d{{4}})', ['n', 'm', 'y']) AS w, regexp_extract(t, '(early|mid|late)\\s+{_M}\\s+(\\d{{4}})', ['n', 'm', 'y']) AS e,
      regexp_extract(t, '\\b(\\d{{1,2}})(?:st|nd|rd|th)?\\s+(?:of\\s+)?{_M},?\\s+(\\d{{4}})', ['d', 'm', 'y']) AS d1, regexp_extract(t, '{_M}\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})', ['m', 'd', 'y']) AS d2,
      regexp_extract(t, '{_M}\\s+(\\d{{4}})', ['m', 'y']) AS m, regexp_extract(t, '\\b(?:in|during)\\s+(20\\d{{2}})\\b', 1) AS y FROM q),
    b AS (SELECT qid, CASE WHEN w.n <> '' THEN 1 WHEN e.n <> '' THEN 2 WHEN d1.d <> '' THEN 3 WHEN d2.d <> '' THEN 4 WHEN m.m <> '' THEN 5 WHEN y <> '' THEN 6 END AS kind, w, e, d1, d2, m, y FROM a),
    c AS (SELECT *, CASE kind WHEN 1 THEN make_date(try_cast(w.y AS INT), {_MN.format('w.m')}, 1) WHEN 2 THEN make_date(try_cast(e.y AS INT), {_MN.format('e.m')}, 1) WHEN 3 THEN make_date(try_cast(d1.y AS INT), {_MN.format('d1.m')}, try_cast(d1.d AS INT)) WHEN 4 THEN make_date(try_cast(d2.y AS INT), {_MN.format('d2.m')}, try_cast(d2.d AS INT))
      WHEN 5 THEN make_date(try_cast(m.y AS INT), {_MN.format('m.m')}, 1) WHEN 6 THEN make_date(try_cast(y AS INT), 1, 1) END AS s FROM b)
    SELECT qid, (CASE kind WHEN 1 THEN CASE WHEN w.n = 'last' THEN last_day(s) - 6 ELSE s + 7 * (list_position(['first','second','third','fourth'], w.n) - 1)::INT END WHEN 2 THEN s + 10 * (list_position(['early','mid','late'], e.n) - 1)::INT WHEN 3 THEN s - 2 WHEN 4 THEN s - 2 ELSE s END)::DATE::VARCHAR AS since,
      (CASE kind WHEN 1 THEN CASE WHEN w.n = 'last' THEN last_day(s) ELSE s + 7 * (list_position(['first','second','third','fourth'], w.n) - 1)::INT + 6 END WHEN 2 THEN CASE WHEN e.n = 'late' THEN last_day(s) ELSE s + 10 * (list_position(['early','mid','late'], e.n) - 1)::INT + 9 END
      WHEN 3 THEN s + 2 WHEN 4 THEN s + 2 WHEN 5 THEN last_day(s) WHEN 6 THEN make_date(try_cast(y AS INT), 12, 31) END)::DATE::VARCHAR AS until FROM c""")
def date_window(spark, root):
    w = _asked_dates(spark).select("qid", dates.date_window(F.col("text")).alias("w"))
    return w.select("qid", F.col("w.since").alias("since"), F.col("w.until").alias("until"))


_CUES = ["it was yesterday", "the day before yesterday", "3 days ago", "2 weeks ago", "14 months ago", "a month ago", "a year ago", "last friday", "last sunday", "last week", "last month", "last year", "nothing"]
_DAYS = "['sunday','monday','tuesday','wednesday','thursday','friday','saturday']"
_CASES = {
    "it was yesterday": "d - 1", "the day before yesterday": "d - 2", "3 days ago": "d - 3", "2 weeks ago": "d - 14", "14 months ago": "d - INTERVAL 14 MONTH", "a month ago": "d - INTERVAL 1 MONTH", "last week": "d - 7", "last month": "d - INTERVAL 1 MONTH",
    "a year ago": "CASE WHEN month(d) = 2 AND day(d) = 29 THEN make_date(year(d) - 1, 3, 1) ELSE d - INTERVAL 1 YEAR END", "last year": "CASE WHEN month(d) = 2 AND day(d) = 29 THEN make_date(year(d) - 1, 3, 1) ELSE d - INTERVAL 1 YEAR END",
    "last friday": "d - CASE WHEN (dayofweek(d) - 5 + 7) % 7 = 0 THEN 7 ELSE (dayofweek(d) - 5 + 7) % 7 END::INT", "last sunday": "d - CASE WHEN dayofweek(d) % 7 = 0 THEN 7 ELSE dayofweek(d) % 7 END::INT", "nothing": "NULL",
}


@query("WITH r AS (SELECT DISTINCT created_at::DATE AS d FROM memory_frames), c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS cue, d, ({v})::DATE::VARCHAR AS resolved FROM r" for k, v in _CASES.items()) + ") SELECT cue, d::VARCHAR AS ref, resolved FROM c")
def relative_date(spark, root):
    days = table(spark, root, "memory_frames").select(F.to_date("created_at").alias("d")).distinct()
    cues = days.select("d", F.explode(F.array(*map(F.lit, _CUES))).alias("cue"))
    return cues.select("cue", F.col("d").cast("string").alias("ref"), dates.relative_date(F.col("cue"), F.col("d")).alias("resolved"))


@query("""SELECT msg_id, msg_timestamp, coalesce(regexp_matches(msg_timestamp, '^\\d{4}-\\d{2}-\\d{2}T([01]\\d|2[0-3]):[0-5]\\d(:[0-5]\\d(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})$') AND try_cast(substr(msg_timestamp, 1, 10) AS DATE) IS NOT NULL, false) AS iso FROM conversation_messages""")
def iso_timestamps(spark, root):
    return messages(spark, root).select("msg_id", "msg_timestamp", dates.is_iso(F.col("msg_timestamp")).alias("iso"))


@query("SELECT id, '[' || strftime(created_at, '%Y-%m-%d') || '] ' || substr(content, 1, 40) AS snippet, strftime(created_at, '%G-W%V') AS week FROM memory_frames")
def dated_snippet(spark, root):
    return table(spark, root, "memory_frames").select("id", dates.dated_snippet(F.col("created_at"), F.substring("content", 1, 40)).alias("snippet"), dates.iso_week(F.col("created_at")).alias("week"))


@query(r"""SELECT msg_id, '[mind-rawturn conv:' || substr(regexp_replace(item_id, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 64) || ' turn:' || turn || ' speaker:' || msg_role || ']' AS header, turn FROM
    (SELECT DISTINCT msg_id, item_id, msg_role, msg_idx, dense_rank() OVER (PARTITION BY item_id ORDER BY msg_idx, msg_id) - 1 AS turn FROM conversation_messages WHERE msg_role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')""")
def raw_turns(spark, root):
    from pyspark.sql.window import Window

    kept = messages(spark, root).filter("msg_role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''").select("msg_id", "item_id", "msg_role", "msg_idx").distinct()
    turn = kept.withColumn("turn", (F.dense_rank().over(Window.partitionBy("item_id").orderBy("msg_idx", "msg_id")) - 1).cast("long"))
    return turn.select("msg_id", fn.turn_header(F.col("item_id"), F.col("turn"), F.col("msg_role")).alias("header"), "turn")


@query("SELECT id, try_cast(json_extract_string(properties, '$.mentions') AS INT) AS mentions, json_extract_string(properties, '$.lang') AS lang FROM knowledge_entities")
def json_props(spark, root):
    return table(spark, root, "knowledge_entities").select("id", F.get_json_object("properties", "$.mentions").try_cast("int").alias("mentions"), F.get_json_object("properties", "$.lang").alias("lang"))


@query(r"""SELECT doc_id, nullif(trim(regexp_extract(regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1), '(?m)^\s*name\s*:(.*)$', 1)), '') AS name, nullif(trim(regexp_extract(regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1), '(?m)^\s*type\s*:(.*)$', 1)), '') AS type FROM documents WHERE starts_with(text, '---' || chr(10))""")
def front_matter(spark, root):
    c = F.col("text")
    return table(spark, root, "documents").filter(c.startswith("---\n")).select("doc_id", fn.front_matter(c, "name").alias("name"), fn.front_matter(c, "type").alias("type"))


@query(f"""SELECT d.doc_id, line FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS line FROM documents WHERE text IS NOT NULL) d WHERE length(trim(line)) >= 10 AND regexp_matches(line, '{_re(fixed.DECISION)}')""")
def decision_lines(spark, root):
    lines = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter((F.length(F.trim("line")) >= 10) & F.col("line").rlike(fixed.any_of(fixed.DECISION)))
