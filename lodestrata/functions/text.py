"""Functions on text columns, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import fixed

NUL = "\u0000"
#: White space at either end, Unicode's included.
_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def strip_session_header(c: Column) -> Column:
    """Without one leading ``[hm ...]`` header and the white space behind it."""
    return F.regexp_replace(c, r"^\[hm [^\]]*\]\s*", "")


def frame_hash(c: Column) -> Column:
    return F.sha2(trimmed(strip_session_header(c)), 256)


def nul_joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; nulls count as empty."""
    return F.sha2(F.concat_ws(NUL, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def archive_uid(source: Column, ref: Column, content: Column) -> Column:
    return nul_joined_hash(source, ref, content)


def stable_id(source: Column, *parts: Column) -> Column:
    return F.substring(nul_joined_hash(source, *parts), 1, 40)


def decision_id(parent: Column) -> Column:
    return stable_id(F.lit("claude-code"), F.lit("decision-of"), parent)


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(dashed, "^-", ""), "-$", ""), 1, 80)


def workspace_of(cwd: Column, home: str) -> Column:
    """personal for the home and root folders, else ``proj-`` and the folder's slug."""
    clean = F.regexp_replace(F.regexp_replace(cwd, r"\\", "/"), "/+$", "")
    folder = F.regexp_extract(clean, "([^/]+)$", 1)
    return F.when(clean.isin("", home.rstrip("/")) | cwd.isNull(), "personal").otherwise(F.concat(F.lit("proj-"), slug(folder)))


def entity_key(c: Column) -> Column:
    """The lower-case name, aliases replaced."""
    pairs = [F.lit(x) for group in fixed.NAME_ALIASES for alias in group for x in (alias, group[0])]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(c)), F.lower(c))


def is_acronym(c: Column) -> Column:
    return c.rlike("^[A-Z]{1,6}$")


def is_noise_name(c: Column) -> Column:
    """Too little of a name for the graph."""
    named = F.length(c) < 4
    return F.when(F.coalesce(c, F.lit("")) == "", True).when(F.lower(c).isin(fixed.TECH_NAMES), False).when(named, True).when(c.isin(fixed.STOP_TOKENS), True).otherwise(~c.rlike(r"\s") & is_acronym(c))


def is_noise_entity(name: Column, kind: Column) -> Column:
    low = F.trim(F.lower(name))
    person = (kind == "person") & (low.rlike(r"^(step|phase|part|section|item|task|bug|fix|test)\b") | low.rlike(r"^(the|a|an|this|that|my|your)\s"))
    return (F.length(low) <= 2) | low.isin(fixed.NOISE_NAMES) | low.rlike(r"^\d+$") | F.coalesce(person, F.lit(False))


def candidate_entities(c: Column) -> Column:
    """Capitalised phrases of several words, then single words that aren't noise; distinct, in order.

    Word borders are those of ASCII words, whatever letter stands beyond.
    """
    phrases = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]+(?:\s+(?:de|of|&)\s+|\s+)[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)(?![A-Za-z0-9_])"), F.lit(1))
    words = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]{2,})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.concat(F.filter(phrases, lambda x: F.length(x) >= 4), F.filter(words, lambda x: ~is_noise_name(x))))


def injection(c: Column, context: Column) -> Column:
    """safe, score and flags of an attempt to take over a model."""
    role, prompt, instruction = (c.rlike(fixed.any_of(p)) for p in (fixed.ROLE_OVERRIDE, fixed.PROMPT_EXTRACTION, fixed.INSTRUCTION_INJECTION))
    score = F.least(F.lit(1.0), F.when(role, 0.5).otherwise(0.0) + F.when(prompt, 0.4).otherwise(0.0) + F.when(instruction, F.when(context == "tool_output", 0.6).otherwise(0.3)).otherwise(0.0))
    flags = F.array_compact(F.array(F.when(role, F.lit("role_override")), F.when(prompt, F.lit("prompt_extraction")), F.when(instruction, F.lit("instruction_injection"))))
    return F.struct((score < 0.3).alias("safe"), score.alias("score"), flags.alias("flags"))


def has_negation(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.any_of(fixed.NEGATION)), F.lit(False))


def asks_why(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.any_of(fixed.WHY)), F.lit(False))


def reports_failure(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.any_of(fixed.FAILURE)) & ~c.rlike(fixed.any_of(fixed.RESOLVED)), F.lit(False))


def is_bookkeeping(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.BOOKKEEPING), F.lit(False))


TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def query_terms(c: Column) -> Column:
    """What a typed query searches for: words cleaned to ASCII letters, digits and underscores, longer than two, no stop words."""
    words = F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z0-9_]", ""))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(fixed.QUERY_STOP_WORDS)), F.lower))


def prompt_tokens(c: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(fixed.PROMPT_STOP_WORDS))


def last_unique(a: Column, n: int) -> Column:
    """The last ``n`` distinct elements, in order of their last occurrence."""
    return F.reverse(F.slice(F.array_distinct(F.reverse(a)), 1, n))


def rule_tokens(c: Column) -> Column:
    """Words of four letters and more, lightly stemmed, no stop words, distinct."""

    def stem(w: Column) -> Column:
        n = F.length(w)
        cut = lambda k: F.substring(w, F.lit(1), n - k)
        return (
            F.when(n < 5, w)
            .when(w.endswith("ies"), F.concat(cut(3), F.lit("y")))
            .when(w.endswith("ing") & (n > 6), cut(3))
            .when(w.endswith("ed") & (n > 5), cut(2))
            .when(w.endswith("es") & (n > 5), cut(2))
            .when(w.endswith("s") & (n > 4) & ~w.endswith("ss"), cut(1))
            .otherwise(w)
        )

    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z-]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(fixed.RULE_STOP_WORDS)), stem))


def forbidden_words(c: Column, zone: int = 120) -> Column:
    """Rule words within ``zone`` characters from each prohibition, distinct."""
    marker = "|".join(p for p in fixed.NEGATION)
    zones = F.regexp_extract_all(F.lower(c), F.lit(rf"(?s)(?=(?:{marker}))(?=(.{{0,{zone}}}))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(zones, rule_tokens)))


def bold_terms(c: Column) -> Column:
    terms = F.transform(F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1)), lambda t: F.trim(t))
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) > 1) & (F.length(t) < 80)))


def preview(c: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def capped(c: Column, model: Column) -> Column:
    """The part of a text an embedding model takes: 8000 characters for ``*-8k``, else 6000."""
    return F.when(model.endswith("-8k"), F.substring(c, 1, 8000)).otherwise(F.substring(c, 1, 6000))


def content_type(c: Column) -> Column:
    body = F.trim(c)
    low = F.lower(body)
    path = (F.length(body) < 500) & ~F.contains(body, F.lit("\n"))
    return (
        F.when(body.startswith("http://") | body.startswith("https://"), "url")
        .when(path & low.endswith(".pdf"), "pdf")
        .when(path & (low.endswith(".md") | low.endswith(".markdown")), "markdown")
        .when(path & low.endswith(".txt"), "plaintext")
        .when(body.startswith("#") | F.contains(body, F.lit("\n## ")) | F.contains(body, F.lit("\n### ")), "markdown")
        .otherwise("plaintext")
    )


def strip_html(c: Column) -> Column:
    """The readable text of a page."""
    for tag in fixed.HTML_LEFT_OUT:
        c = F.regexp_replace(c, rf"(?is)<{tag}.*?</{tag}>", "")
    for n in (1, 2, 3):
        c = F.regexp_replace(c, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    for pattern, by in fixed.HTML_BREAKS:
        c = F.regexp_replace(c, pattern, by)
    for entity, by in fixed.HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(by))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"), r"^\s+", ""), r"\s+$", "")


def html_title(c: Column) -> Column:
    found = F.regexp_extract(c, fixed.HTML_TITLE, 1)
    return F.when(c.rlike(fixed.HTML_TITLE), F.regexp_replace(F.trim(found), r"\s+", " "))


def html_description(c: Column) -> Column:
    first, second = (F.regexp_extract(c, p, 1) for p in fixed.HTML_DESCRIPTIONS)
    return F.nullif(F.trim(F.when(first != "", first).otherwise(second)), F.lit(""))


def pack_paragraphs(c: Column, most: int = 2000) -> Column:
    """Paragraphs joined while they fit ``most`` characters; a longer one stays whole."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: trimmed(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, p: Column) -> Column:
        now = state["now"]
        full = (F.length(now) + F.length(p) + 2 > most) & (F.length(now) > 0)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"),
            F.when(full, p).otherwise(F.concat(now, F.when(now == "", "").otherwise("\n\n"), p)).alias("now"),
        )

    return F.aggregate(paragraphs, start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def rounded_score(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def conversation_key(conv: Column) -> Column:
    """The id of a conversation as turn headers write it."""
    return F.substring(F.regexp_replace(conv.cast("string"), "[^A-Za-z0-9_.-]", "_"), 1, 64)


def turn_header(conv: Column, turn: Column, speaker: Column) -> Column:
    return F.concat(F.lit("[mind-rawturn conv:"), conversation_key(conv), F.lit(" turn:"), turn.cast("string"), F.lit(" speaker:"), speaker, F.lit("]"))


TURN_HEADER = r"^\[mind-rawturn conv:(\S+) turn:(\d+) speaker:([^\]]+)\]"


def turn_body(c: Column) -> Column:
    at = F.instr(c, "\n")
    return F.when(at > 0, F.trim(c.substr(at + 1, F.length(c)))).otherwise(F.lit(""))


def front_matter(c: Column, key: str) -> Column:
    """The value of ``key`` in a leading ``---`` block."""
    return F.nullif(F.trim(F.regexp_extract(F.regexp_extract(c, r"(?s)^---\n(.*?)\n---\n", 1), rf"(?m)^\s*{key}\s*:(.*)$", 1)), F.lit(""))
