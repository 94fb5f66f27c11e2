"""Words of a text as any export of it would give them, and hashed vectors over them."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

_HEADER = re.compile(r"\[hm [^\]\[]*\]", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Folded words without mark-up, entities, session headers and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _HEADER.sub(" ", text)
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", _UNSEEN.sub("", text).casefold())
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text)


class WordHashes(dict):
    """64-bit hash by word, kept while a task runs; emptied at ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def distinct(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of one of each distinct (row, value), sorted by them."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    return order[np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])] if len(order) else order


def phrases(words: np.ndarray, sizes: np.ndarray, every: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct phrases of some texts: row, 64-bit hash, number of words; sorted by row and hash.

    ``words`` has the word hashes of all texts on end, ``sizes`` how many each text
    has.  A phrase ends where the hash of a word and the next one says so, once in
    ``every`` places, so an edit changes the phrases around it only.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    last = np.zeros(n, bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    last[:-1] |= (mixed(words[:-1], words[1:]) >> np.uint64(33)) % np.uint64(every) == 0
    ends = np.flatnonzero(last) + 1
    long = np.diff(ends, prepend=0)
    starts = ends - long
    place = (np.arange(n) - np.repeat(starts, long)).astype(np.uint64)
    z = (words + place * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    total = np.add.reduceat(z, starts) * np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(32)
    row = np.repeat(np.arange(len(sizes)), sizes)[starts]
    at = distinct(row, total)
    return row[at], total[at], long[at]
