"""The stemmer of M. F. Porter (An algorithm for suffix stripping, 1980), and the analyzer with it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffixes of steps 2 to 4 of the paper.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES2, _RULES3 = ([tuple(r.split(":")) for r in s.split()] for s in (_STEP2, _STEP3))
_WORD = re.compile(r"[^\W_]+")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _ends_short(word: str) -> bool:
    """consonant, vowel, consonant other than w, x, y at the end"""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case ASCII word; other words and those under three letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_RULES2, _RULES3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + new
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if word.endswith(end):
            head = word[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                word = head
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed_words(text: str | None) -> list[str]:
    """Words in lower case without marks, stemmed, in order."""
    if not text:
        return []
    flat = text.lower() if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return [stem(w) for w in _WORD.findall(flat)]


def stemming(texts: DataFrame) -> DataFrame:
    """The analyzer for :func:`lodestrata.operators.search.bm25`: id and terms of ``texts(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([stemmed_words(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["id", "terms"])

    return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, terms array<string>")
