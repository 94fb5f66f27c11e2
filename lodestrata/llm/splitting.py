"""Cutting long texts into pieces below a limit, at natural boundaries, with overlap.

Balanced targets: the smallest number of pieces that could do is computed, as
many equally long targets are placed, and each cut moves to the strongest
boundary near its target.  Where a piece then breaks a limit, one more piece is
tried.  Positions are code points.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200

#: Boundaries by strength; a cut comes behind the match, so white space ends the piece before.
_BOUNDARIES = (
    (5, "paragraph", re.compile(r"(?:(?:\r\n|[\n\r\u2028\u2029])[ \t]*){2,}")),
    (4, "line", re.compile(r"(?:\r\n|[\n\r\u2028\u2029])[ \t]*")),
    (3, "sentence", re.compile(r"(?:[.!?…؟।][\"'”’»)\]]*(?=\s)|[。！？](?=.))\s*", re.S)),
    (2, "clause", re.compile(r"(?:[,;:،–—](?=\s)|[、，；：])\s*")),
    (1, "word", re.compile(r"\s+")),
)


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    boundary: str


def _joins(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part one visible character or a line break."""
    if at <= 0 or at >= len(text):
        return False
    a, b = text[at - 1], text[at]
    # zero-width joiner, variation selectors, marks, skin tones
    return (a == "\r" and b == "\n") or a == "\u200d" or b in "\u200d\ufe0e\ufe0f" or unicodedata.combining(b) != 0 or "\U0001f3fb" <= b <= "\U0001f3ff"


def snap(text: str, target: int, low: int, high: int) -> tuple[int, str]:
    """The strongest boundary in [low, high], of equal ones the nearest to ``target``; else the nearest safe place."""
    low, high = max(low, 1), min(high, len(text))
    if low > high:
        return target, "none"
    window = text[max(0, low - 8) : high + 2]
    base = max(0, low - 8)
    for _, name, pattern in _BOUNDARIES:
        best = -1
        for m in pattern.finditer(window):
            at = base + m.end()
            if low <= at <= high and (best < 0 or abs(at - target) < abs(best - target)):
                best = at
        if best >= 0:
            return best, name
    for step in range(high - low + 1):
        for at in (target - step, target + step):
            if low <= at <= high and not _joins(text, at):
                return at, "none"
    return target, "none"


def _attempt(text: str, n: int, limit: int, overlap: int, reach: float) -> list[Piece]:
    size = (len(text) + (n - 1) * overlap) / n
    step = size - overlap
    out: list[Piece] = []
    start = 0
    for i in range(n):
        if i == n - 1:
            out.append(Piece(start, len(text), "end"))
            break
        target = round(step * (i + 1) + overlap)
        room = int(step * reach)
        high = min(target + room, start + limit, len(text) - 1)
        end, name = snap(text, min(target, high), max(target - room, start + overlap + 1), high)
        out.append(Piece(start, end, name))
        near = overlap // 2 if reach else 0
        start, _ = snap(text, max(end - overlap, 1), max(end - overlap - near, start + 1), max(end - overlap + near, start + 1)) if overlap else (end, name)
    return out


def _fails(text: str, pieces: list[Piece], limit: int, max_bytes: int | None) -> bool:
    for i, p in enumerate(pieces):
        if p.end - p.start > limit or p.end <= p.start or (i and (p.start <= pieces[i - 1].start or p.start > pieces[i - 1].end)):
            return True
        if max_bytes and len(text[p.start : p.end].encode("utf-8", "replace")) > max_bytes:
            return True
    return False


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, max_bytes: int | None = None) -> list[Piece]:
    """Pieces of ``text`` that cover it in order; one where it is within the limits, none where it is empty."""
    if not 0 <= overlap < limit or (max_bytes is not None and max_bytes < 4 * (overlap + 1)):
        raise ValueError("the overlap must be smaller than the limits")
    if not text:
        return []
    whole = [Piece(0, len(text), "end")]
    if not _fails(text, whole, limit, max_bytes):
        return whole
    least = max(2, math.ceil((len(text) - overlap) / (limit - overlap)))
    n = least
    while True:
        # The last tries keep to the targets: equal pieces of at most the limit.
        for reach in (0.3, 0.15, 0.0) if n > least + 1 else (0.3, 0.15):
            pieces = _attempt(text, n, limit, overlap, reach)
            if not _fails(text, pieces, limit, max_bytes):
                return pieces
        n += 1


def locate(text: str, content: str | None, start: int | None, end: int | None) -> int | None:
    """Where ``text`` begins in ``content``: as the old offsets say, or else the place nearest to them."""
    if content is None or not text:
        return None
    for at in (start, None if end is None else end - len(text)):
        if at is not None and at >= 0 and content.startswith(text, at):
            return at
    hint = start if start is not None else end - len(text) if end is not None else 0
    before, after = content.rfind(text, 0, max(0, hint) + len(text)), content.find(text, max(0, hint))
    found = [p for p in (before, after) if p >= 0]
    return min(found, key=lambda p: abs(p - hint)) if found else None


SCHEMA = "src_field string, row_id long, piece int, char_start long, char_end long, boundary string, text string"


def split_records(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every record of ``records``.

    ``records``: src_field, row_id, text, content, char_start, char_end; content
    is the text the offsets count in (null: the text itself).  Result: src_field,
    row_id, piece (from 0), char_start, char_end, boundary, text; offsets are
    null where the text isn't in its content.

    Records within the limit stay one piece and never leave the JVM; null and
    empty texts have no piece.  Every character is in some piece, no piece is
    longer than ``limit``, consecutive ones share about ``overlap`` characters.
    """
    size = F.length("text")
    short = records.filter((size <= limit) & (size > 0))
    at = F.when(F.col("content").isNull(), F.lit(0)).otherwise(F.coalesce(F.when(F.expr("substring(content, char_start + 1, length(text)) = text"), F.col("char_start")), F.expr("nullif(instr(content, text), 0) - 1")))
    whole = short.withColumn("at", at.cast("long")).select("src_field", F.col("row_id").cast("long").alias("row_id"), F.lit(0).alias("piece"), F.col("at").alias("char_start"), (F.col("at") + size).cast("long").alias("char_end"), F.lit("end").alias("boundary"), "text")
    return whole.unionByName(split_long(records, limit, overlap))


def split_long(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the records above the limit alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                text = row["text"]
                base = 0 if row["content"] is None else locate(text, row["content"], row["char_start"], row["char_end"])
                pieces = split_text(text, limit, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["src_field"]] * len(pieces), pa.string()),
                        pa.array([row["row_id"]] * len(pieces), pa.int64()),
                        pa.array(range(len(pieces)), pa.int32()),
                        pa.array([None if base is None else base + p.start for p in pieces], pa.int64()),
                        pa.array([None if base is None else base + p.end for p in pieces], pa.int64()),
                        pa.array([p.boundary for p in pieces], pa.string()),
                        pa.array([text[p.start : p.end] for p in pieces], pa.string()),
                    ],
                    ["src_field", "row_id", "piece", "char_start", "char_end", "boundary", "text"],
                )

    long = records.filter(F.length("text") > limit).select("src_field", F.col("row_id").cast("long").alias("row_id"), "text", "content", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))
    return long.mapInArrow(cut, SCHEMA)
