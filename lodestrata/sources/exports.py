"""Reading exports of chat tools and folders of notes into items.

Exports come as JSON of many shapes.  They are kept as VARIANT and read by paths
with alternatives, so one expression serves all shapes and nothing is parsed
twice; text and roles differ by table, not by code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import fixed
from lodestrata.functions.text import content_type, front_matter, html_description, html_title, stable_id, strip_html, trimmed

#: Where each source keeps its conversations, beside a bare array.
WRAPPERS = {
    "chatgpt": ("conversations",),
    "claude": ("conversations", "design_chats"),
    "gemini": ("conversations",),
    "perplexity": ("threads", "conversations", "items"),
    "universal": ("conversations", "chats", "threads", "sessions", "history", "data"),
}
ROLES = {"user": "user", "human": "user", "question": "user", "assistant": "assistant", "model": "assistant", "gemini": "assistant", "ai": "assistant", "perplexity": "assistant", "answer": "assistant", "tool": "assistant", "bot": "assistant", "system": "system"}
#: Needles that tell a pasted text's source, in the order they are tried.
NEEDLES = (("perplexity", "perplexity"), ("grok", "grok"), ("x.ai", "grok"), ("manus", "manus"), ("genspark", "genspark"), ("qwen", "qwen"), ("tongyi", "qwen"), ("minimax", "minimax"), ("elevenlabs", "elevenlabs"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*(_get(v, p, kind) for p in paths))


def _texts(a: Column, each) -> Column:
    """The texts of an array's elements, those without left out, one per line."""
    return F.nullif(trimmed(F.array_join(F.filter(F.transform(a, each), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")), F.lit(""))


def _part(p: Column) -> Column:
    """A part of a message: text, a text block, or what stands for a picture or file."""
    kind = F.coalesce(_get(p, "$.type"), F.lit("text"))
    image = F.when(F.coalesce(_get(p, "$.content_type"), F.lit("")).contains("image"), F.concat(F.lit("[Shared image: "), _get(p, "$.metadata.dalle.prompt"), F.lit("]")))
    file = F.when(_first(p, "$.fileData.mimeType", "$.inlineData.mimeType").isNotNull(), F.concat(F.lit("[Shared file: "), _first(p, "$.fileData.mimeType", "$.inlineData.mimeType"), F.lit("]")))
    plain = F.when(F.schema_of_variant(p) == "STRING", _get(p, "$"))
    return F.coalesce(plain, F.when(kind == "text", _get(p, "$.text")), image, file)


def _attachment(a: Column) -> Column:
    name, text = _first(a, "$.file_name", "$.name"), trimmed(_get(a, "$.extracted_content"))
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("[Attached: "), F.coalesce(name, F.lit("file")), F.lit("] "), F.substring(text, 1, 500))).otherwise(F.concat(F.lit("[Shared file: "), name, F.lit("]")))


def _message_text(m: Column) -> Column:
    parts = _first(m, "$.content.parts", "$.content", "$.parts", kind="array<variant>")
    strings = F.coalesce(*(F.when(F.schema_of_variant(_get(m, p, "variant")) == "STRING", trimmed(_get(m, p))) for p in ("$.text", "$.content", "$.answer", "$.query")))
    body = F.coalesce(_texts(parts, _part), F.nullif(strings, F.lit("")))
    named = _texts(_get(m, "$.metadata.attachments", "array<variant>"), lambda a: F.concat(F.lit("[Attached: "), _get(a, "$.name"), F.lit("]")))
    files = [_texts(_get(m, p, "array<variant>"), _attachment) for p in ("$.attachments", "$.files")]
    text = F.nullif(F.concat_ws("\n", body, named, *files), F.lit(""))
    links = F.array_join(F.filter(F.transform(_first(m, "$.sources", "$.citations", kind="array<variant>"), lambda s: F.coalesce(F.when(F.schema_of_variant(s) == "STRING", _get(s, "$")), _first(s, "$.url", "$.title"))), lambda s: s.isNotNull()), ", ")
    return F.when(F.coalesce(links, F.lit("")) != "", F.concat(text, F.lit("\n\nSources: "), links)).otherwise(text)


def messages(exports: DataFrame) -> DataFrame:
    """Every message of ``exports(export_id, source, payload)``.

    Result: export_id, source, conv_idx, conv_id, title, started, msg_idx, role,
    text, at.  System messages and messages without text are left out; a payload
    that isn't JSON or holds no conversation has no rows.
    """
    root = F.try_parse_json("payload").alias("root")
    parsed = exports.select("export_id", "source", root)
    r = F.col("root")
    listed = F.lit(None).cast("array<variant>")
    for source, keys in WRAPPERS.items():
        found = F.coalesce(_get(r, "$", "array<variant>"), *(_get(r, f"$.{k}", "array<variant>") for k in keys))
        listed = F.when(F.col("source") == source, found).otherwise(listed)
    single = F.when(_first(r, "$.history", "$.messages", kind="array<variant>").isNotNull() & F.col("source").isin("gemini", "perplexity", "universal"), F.array(r))
    bare = F.when(F.coalesce(_first(F.get(listed, F.lit(0)), "$.role", "$.sender", "$.author").isNotNull(), F.lit(False)) & (F.col("source") == "universal"), F.array(r))
    conversations = F.coalesce(bare, listed, single)
    convs = parsed.select("export_id", "source", F.posexplode(conversations).alias("conv_idx", "conv"))
    c = F.col("conv")
    nodes = F.transform(F.map_values(_get(c, "$.mapping", "map<string,variant>")), lambda n: _get(n, "$.message", "variant"))
    entries = F.coalesce(nodes, _first(c, "$.messages", "$.chat_messages", "$.turns", "$.history", "$.conversations", kind="array<variant>"), _get(c, "$", "array<variant>"))
    head = convs.select("export_id", "source", "conv_idx", _first(c, "$.id", "$.uuid", "$.conversation_id", "$.conversationId", "$.threadId").alias("conv_id"), _first(c, "$.title", "$.name", "$.subject").alias("title"), _first(c, "$.create_time", "$.created_at", "$.createTime", "$.timestamp").alias("started"), F.posexplode(entries).alias("place", "m"))
    m = F.col("m")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.lower(_first(m, "$.author.role", "$.role", "$.sender", "$.author", "$.type")))
    time = _get(m, "$.create_time", "double")
    read = head.select("export_id", "source", "conv_idx", "conv_id", F.coalesce("title", F.lit("Untitled")).alias("title"), "started", "place", F.coalesce(time, F.lit(0.0)).alias("order"), role.alias("role"), _message_text(m).alias("text"), F.coalesce(_first(m, "$.created_at", "$.timestamp", "$.createTime"), F.when(time > 0, F.date_format(F.timestamp_micros((time * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).alias("at"))
    kept = read.filter("role IN ('user', 'assistant') AND coalesce(text, '') <> ''")
    w = Window.partitionBy("export_id", "conv_idx").orderBy("order", "place")
    return kept.withColumn("msg_idx", F.row_number().over(w) - 1).drop("order", "place")


def items(read: DataFrame) -> DataFrame:
    """One item per conversation of :func:`messages`: item_id, source, title, content, n_messages, started."""
    parts = read.groupBy("export_id", "source", "conv_idx", "conv_id", "title", "started").agg(F.array_sort(F.collect_list(F.struct("msg_idx", F.concat("role", F.lit(": "), "text").alias("line")))).alias("lines"))
    content = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    key = F.coalesce("conv_id", F.concat_ws("\u0000", F.lit("conv"), "title", F.coalesce("started", F.lit("")), content))
    return parts.select(stable_id(F.col("source"), key).alias("item_id"), "source", "title", content.alias("content"), F.size("lines").alias("n_messages"), "started")


def source_of_text(c: Column) -> Column:
    """The tool that a pasted text names first in the list of needles."""
    low, out = F.lower(c), F.lit("unknown")
    for needle, name in reversed(NEEDLES):
        out = F.when(low.contains(needle), name).otherwise(out)
    return out


def transcript(texts: DataFrame) -> DataFrame:
    """Turns of pasted transcripts ``texts(id, text)`` whose lines begin with a speaker: id, turn, role, text."""
    marker = r"(?im)^\s*(user|human|you|assistant|ai|bot|model)\s*:\s*"
    pieces = F.regexp_extract_all("text", F.lit(marker + r"((?:(?!^\s*(?:user|human|you|assistant|ai|bot|model)\s*:)[\s\S])*)"), F.lit(2))
    speakers = F.regexp_extract_all("text", F.lit(marker), F.lit(1))
    cut = texts.select("id", F.posexplode(F.arrays_zip(speakers.alias("who"), pieces.alias("said"))).alias("turn", "x"))
    role = F.when(F.lower("x.who").isin("user", "human", "you"), "user").otherwise("assistant")
    return cut.select("id", "turn", role.alias("role"), trimmed(F.col("x.said")).alias("text")).filter("text <> ''")


def notes(spark: SparkSession, folder: str, least: int = 50, most: int = 4000) -> DataFrame:
    """Markdown files below an agent's home: item_id, kind, path, title, description, content.

    Kinds by path: memory, rule, plan, settings or document; shorter files than
    ``least`` characters are left out, longer ones than ``most`` cut.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,json,markdown,txt}").select(F.input_file_name().alias("path"), "value")
    kind = F.when(F.col("path").rlike("/memory/[^/]+$"), "memory").when(F.col("path").rlike("/rules/"), "rule").when(F.col("path").rlike("/plans/"), "plan").when(F.col("path").rlike("/settings[^/]*\\.json$"), "settings").otherwise("document")
    body = trimmed(F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", ""))
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.filter(F.length("value") >= least).select(stable_id(F.lit("claude-code"), F.col("path")).alias("item_id"), kind.alias("kind"), "path", F.coalesce(front_matter(F.col("value"), "name"), name).alias("title"), front_matter(F.col("value"), "description").alias("description"), F.substring(body, 1, most).alias("content"))


def decisions(found: DataFrame) -> DataFrame:
    """Lines of items that record a decision: item_id and content of the derived item."""
    from lodestrata.functions.text import decision_id

    lines = found.filter("kind NOT IN ('decision', 'rule')").select("item_id", F.filter(F.split("content", "\n"), lambda x: (F.length(trimmed(x)) >= 10) & x.rlike(fixed.any_of(fixed.DECISION))).alias("lines"))
    return lines.filter(F.size("lines") > 0).select(decision_id(F.col("item_id")).alias("item_id"), F.array_join("lines", "\n").alias("content"))


def status_files(spark: SparkSession, folder: str, whole: int = 30_000, slice_: int = 25_000) -> DataFrame:
    """STATE, DECISIONS and PROGRESS files of a tree in slices: path, part, content with a header line."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{STATE,DECISIONS,PROGRESS}.md").select(F.input_file_name().alias("path"), "value")
    n = F.when(F.octet_length("value") <= whole, F.lit(1)).otherwise(F.ceil(F.length("value") / slice_).cast("int"))
    size = F.when(n == 1, F.length("value")).otherwise(F.lit(slice_))
    cut = files.select("path", "value", size.alias("size"), n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("part"))
    head = F.concat(F.lit("[harvest "), F.regexp_extract("path", "([^/]+)$", 1), F.lit(" part "), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("]\n"))
    return cut.select("path", "part", F.concat(head, F.col("value").substr(F.col("part") * F.col("size") + 1, F.col("size"))).alias("content"))


def queue_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of JSON lines; lines that can't be read are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def page_items(pages: DataFrame, least: int = 50, most: int = 4000, section: int = 30) -> DataFrame:
    """Items of web pages ``pages(id, title, html)``: id, section, title, content, description.

    A page under ``least`` characters of text has none, one up to ``most`` is one
    item, a longer one is cut before its headings; sections under ``section``
    characters are left out, longer ones than ``most`` cut.
    """
    plain = pages.select("id", F.coalesce(html_title(F.col("html")), "title").alias("title"), html_description(F.col("html")).alias("description"), strip_html(F.col("html")).alias("plain")).filter(F.length("plain") >= least)
    size = F.length("plain")
    parts = F.when(size <= most, F.array("plain")).otherwise(F.split("plain", r"\n(?=#{1,3}\s)"))
    cut = plain.select("id", "title", "description", size.alias("size"), F.posexplode(parts).alias("section", "part")).withColumn("part", trimmed(F.col("part")))
    return cut.filter((F.col("size") <= most) | (F.length("part") >= section)).select("id", "section", "title", F.substring("part", 1, most).alias("content"), "description")


def export_pages(pages: DataFrame, folder: str) -> None:
    """Write ``pages(slug, markdown)`` as one folder of text per slug."""
    pages.select("slug", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("slug").text(folder)


def any_text(inputs: DataFrame) -> DataFrame:
    """id and the kind of reader that pasted inputs (id, text) need."""
    return inputs.select("id", content_type(F.col("text")).alias("reader"))


READERS = {**{s: messages for s in WRAPPERS}, "plaintext": transcript, "claude-code": notes, "tree": status_files}
