"""Ingestion stages around pluggable models: embedding, language model, reranker.

A model is a Python callable; it is called once per Arrow batch inside a task.
The defaults are deterministic and need no model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.dates import is_iso
from lodestrata.functions.text import capped, injection, turn_header

Embed = Callable[[list[str]], np.ndarray]
Complete = Callable[[list[str]], list[str | None]]


def byte_embedding(dims: int) -> Embed:
    """The embedder of tests: (byte - 128) / 128 of the first ``dims`` UTF-8 bytes, zeros behind."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts):
            data = np.frombuffer(text.encode("utf-8", "replace")[:dims], np.uint8)
            row[: len(data)] = (data.astype(np.float32) - 128) / 128
        return out

    return embed


def echo(prompts: list[str]) -> list[str | None]:
    """The model of tests: the first eight lines of a prompt, 200 characters each."""
    return ["\n".join(line[:200] for line in p.split("\n")[:8]) for p in prompts]


def fitted(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Cut or padded with zeros to ``dims``."""
    have = vectors.shape[1]
    return vectors[:, :dims] if have >= dims else np.pad(vectors, ((0, 0), (0, dims - have)))


def embedded(texts: DataFrame, embed: Embed, dims: int, model: str = "small") -> DataFrame:
    """id and embedding of ``texts(id, text)``, the text capped as the model takes it; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = fitted(np.asarray(embed(b.column("text").to_pylist()), np.float32).reshape(b.num_rows, -1), dims) if b.num_rows else np.zeros((0, dims), np.float32)
            ends = pa.array(np.arange(0, (b.num_rows + 1) * dims, dims, dtype=np.int32)[: b.num_rows + 1])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(vectors.reshape(-1)))], ["id", "embedding"])

    ready = texts.filter("text IS NOT NULL").select(F.col("id").cast("long").alias("id"), capped(F.col("text"), F.lit(model)).alias("text"))
    return ready.mapInArrow(run, "id long, embedding array<float>")


def completed(prompts: DataFrame, complete: Complete) -> DataFrame:
    """id and the model's answer to each of ``prompts(id, prompt)``; a failing batch answers null, the job goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = [p or "" for p in b.column("prompt").to_pylist()]
            try:
                answers = complete(asked)
            except Exception:
                answers = [None] * len(asked)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(answers, pa.string())], ["id", "answer"])

    return prompts.select(F.col("id").cast("long").alias("id"), "prompt").mapInArrow(run, "id long, answer string")


def json_answer(c: Column) -> Column:
    """The JSON object of an answer, out of a fence or surrounding words; null where there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"(?s)^.*?```(?:json)?\s*|```.*$", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def screened(items: DataFrame, probe: int = 4000) -> DataFrame:
    """Items with ``blocked``: whether title and content, their first ``probe`` characters, try to take over a model."""
    title = F.coalesce("title", F.lit("")) if "title" in items.columns else F.lit("")
    text = F.concat(title, F.lit("\n"), F.coalesce("content", F.lit("")))
    return items.withColumn("blocked", F.coalesce(~injection(F.substring(text, 1, probe), F.lit("tool_output"))["safe"], F.lit(False)))


def distilled(items: DataFrame, complete: Complete, schema: str = "importance string, content string, confidence double", shown: int | None = 1200) -> DataFrame:
    """Screened items through one model call each: id and the fields of the answers that can be read.

    ``items``: id, content.  A prompt has the first ``shown`` characters of an item,
    as the models it is for have a limited context; whole items go in if it is None.
    Blocked items and unreadable answers give no row; a missing confidence is 0.7.
    """
    safe = screened(items).filter("NOT blocked")
    prompts = safe.select("id", F.concat(F.lit("Distill as JSON:\n"), F.substring("content", 1, shown) if shown else F.col("content")).alias("prompt"))
    read = completed(prompts, complete).select("id", F.from_json(json_answer(F.col("answer")), schema).alias("x")).filter("x.content IS NOT NULL")
    return read.select("id", "x.importance", "x.content", F.coalesce("x.confidence", F.lit(0.7)).alias("confidence"))


def turn_frames(messages: DataFrame, cap: int = 2000, longest: int = 10_000) -> DataFrame:
    """Frames of single turns of ``messages(conv, turn, role, text, at)``: conv, turn, content, created_at.

    Only user and assistant turns with text, in their order, numbered anew from 0;
    texts that try to take over a model or are longer than ``longest`` are left
    out, others cut to ``cap``.  A time that is no full ISO instant is null.
    """
    kept = messages.filter("role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''")
    kept = kept.filter((F.length("text") <= longest) & injection(F.col("text"), F.lit("user_input"))["safe"])
    nth = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "text")) - 1
    numbered = kept.withColumn("n", nth)
    return numbered.select("conv", F.col("n").alias("turn"), F.concat(turn_header(F.col("conv"), F.col("n"), F.col("role")), F.lit("\n"), F.substring("text", 1, cap)).alias("content"), F.when(is_iso(F.col("at")), F.col("at").try_cast("timestamp").cast("timestamp_ntz")).alias("created_at"))


def lane_frames(extracted: DataFrame) -> DataFrame:
    """Frames of ``extracted(kind, speaker, text, day, seen)``: facts and events once each, profiles only the latest per speaker.

    Events need a day; the content names kind, speaker and day.
    """
    once = extracted.filter("kind = 'fact' OR (kind = 'event' AND day IS NOT NULL)").dropDuplicates(["kind", "speaker", "text", "day"])
    latest = Window.partitionBy("speaker").orderBy(F.desc("seen"), F.desc("text"))
    profile = extracted.filter("kind = 'profile'").withColumn("k", F.row_number().over(latest)).filter("k = 1").drop("k")
    both = once.unionByName(profile)
    head = F.concat(F.lit("["), "kind", F.lit(" speaker:"), F.coalesce("speaker", F.lit("?")), F.coalesce(F.concat(F.lit(" day:"), F.col("day").cast("string")), F.lit("")), F.lit("] "))
    return both.select("kind", "speaker", F.concat(head, "text").alias("content"))


def chunk_text(text: str | None, most: int = 2000, overlap: int = 200, whole: int = 1500) -> list[tuple[str, int, int]]:
    """Pieces for embedding: (text, start, end).

    Up to ``whole`` characters one piece; else paragraphs, those over ``most`` by
    sentence, those by length, packed while they fit; each piece but the first
    begins with the last ``overlap`` characters of the one before, which its
    offsets (code points) don't count.
    """
    if not text:
        return []
    if len(text) <= whole:
        return [(text, 0, len(text))]

    def between(pattern: str, low: int, high: int, keep: bool) -> Iterator[tuple[int, int]]:
        at = low
        for m in re.finditer(pattern, text[low:high]):
            end = low + (m.end() if keep else m.start())
            if text[at:end].strip():
                yield at, end
            at = low + m.end()
        if text[at:high].strip():
            yield at, high

    spans: list[tuple[int, int]] = []
    for a, b in between(r"\n\s*\n", 0, len(text), False):
        for c, d in [(a, b)] if b - a <= most else between(r"[.!?](?:\s+|$)", a, b, True):
            spans += [(x, min(x + most, d)) for x in range(c, d, most)]
    packed: list[list[tuple[int, int]]] = []
    size = 0
    for a, b in spans or [(0, len(text))]:
        if packed and size + 2 + b - a <= most:
            packed[-1].append((a, b))
            size += 2 + b - a
        else:
            packed.append([(a, b)])
            size = b - a
    out: list[tuple[str, int, int]] = []
    for group in packed:
        body = "\n\n".join(text[a:b] for a, b in group)
        if out and overlap:
            tail = out[-1][0][-overlap:]
            body = tail + ("" if tail.endswith("\n") else "\n") + body
        out.append((body, group[0][0], group[-1][1]))
    return out


def chunks(frames: DataFrame) -> DataFrame:
    """frame_id, chunk_idx, text, char_start, char_end of ``frames(id, content)``; null and empty contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *c) for i, t in zip(b.column("id").to_pylist(), b.column("content").to_pylist()) for n, c in enumerate(chunk_text(t))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["frame_id", "chunk_idx", "text", "char_start", "char_end"])

    return frames.select(F.col("id").cast("long").alias("id"), "content").mapInArrow(run, "frame_id long, chunk_idx int, text string, char_start long, char_end long")


def digest(frames: DataFrame, start: str, days: int = 7, shown: int = 12, width: int = 80) -> DataFrame:
    """mind, n and a text of the newest ``shown`` frames of the days before ``start``."""
    at = F.lit(start).cast("timestamp_ntz")
    week = frames.filter((F.col("created_at") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") < at))
    w = Window.partitionBy("mind").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = week.withColumn("k", F.row_number().over(w))
    line = F.concat(F.lit("- ["), F.substring(F.col("created_at").cast("string"), 1, 10), F.lit("] "), F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, width))
    grouped = ranked.groupBy("mind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", line.alias("line"))))).alias("lines"))
    return grouped.select("mind", "n", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
