"""Exact byte-pair encoding in linear time by backtracking, and decoding by an offset table."""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np

#: White space as the splitting pattern of the rank files has it (Unicode White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(kind: str, codes: range) -> str:
    """The characters of ``codes`` whose general category starts with ``kind``, as the inside of a character class."""
    out, start = [], None
    for code in [*codes, -1]:
        if code >= 0 and unicodedata.category(chr(code))[0] == kind:
            start = code if start is None else start
            last = code
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    return "".join(out)


def _pattern(codes: range) -> re.Pattern[str]:
    letters, numbers = _ranges("L", codes), _ranges("N", codes)
    return re.compile(f" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    """What finds characters beyond the basic plane, and the splitting pattern without and with those (much slower)."""
    return re.compile("[\U00010000-\U0010ffff]"), _pattern(range(0x10000)), _pattern(range(sys.maxunicode + 1))


def pieces_of(text: str) -> list[str]:
    """The pieces of ``text`` that are encoded one by one; together they are the text."""
    beyond, basic, full = _patterns()
    return (full if beyond.search(text) else basic).findall(text)


class Encoder:
    """Encodes with the merges that a rank file implies.

    A piece is read from the left, each time with the longest token that an
    automaton over the vocabulary finds.  A token may follow another only where
    no merge would have crossed their border; that is looked up in a table of
    splits.  Where it may not, the next shorter token is tried, and where none is
    left the last token is taken back; a border that failed once isn't tried again.
    """

    def __init__(self, path: str, keep: int = 400_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.size = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._prefixes()
        self._splits()
        self.keep, self.known = keep, {}
        lengths = np.array(self.size, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _prefixes(self) -> None:
        """For each token the longest shorter token that it begins with, or -1."""
        self.shorter = [-1] * len(self.tokens)
        for token, rank in self.ranks.items():
            for end in range(len(token) - 1, 0, -1):
                found = self.ranks.get(token[:end])
                if found is not None:
                    self.shorter[rank] = found
                    break

    def _splits(self) -> None:
        """The two tokens whose merge makes each token; a token that nothing makes stands for itself."""
        self.left, self.right, self.merged = list(range(len(self.tokens))), list(range(len(self.tokens))), {}
        for rank, token in enumerate(self.tokens):
            head = self.shorter[rank]
            while head >= 0:
                tail = self.ranks.get(token[self.size[head] :])
                if tail is not None and head < rank and tail < rank and self.compatible(head, tail):
                    self.left[rank], self.right[rank] = head, tail
                    self.merged[head, tail] = rank
                    break
                head = self.shorter[head]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between ``a`` and ``b`` in place.

        Both are taken apart from their latest merge backwards; a merge across the
        border that would come before the merge just undone breaks the border.
        """
        before = 1 << 60
        while True:
            crossing = self.merged.get((a, b))
            if crossing is not None and crossing < before:
                return False
            inner_a, inner_b = self.right[a], self.left[b]
            undo_a = inner_a != a and (a > b or inner_b == b)
            if undo_a:
                before, a = a, inner_a
            elif inner_b != b:
                before, b = b + 1, inner_b
            else:
                return True

    def _longest_at(self, piece: str, at: int) -> int:
        for _, rank in self.automaton.iter_long(piece[at : at + self.longest]):
            return rank
        return -1

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        open_at = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        at, token = 0, self._longest_at(text, 0)
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + self.size[token]
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = self._longest_at(text, at) if at < len(data) else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                open_at[at] = 0
                token = out.pop()
                at -= self.size[token]
                break
        return out

    def _piece(self, piece: str) -> bytes:
        if len(self.known) >= self.keep:
            self.known.clear()
        value = self.known[piece] = np.array(self.encode_piece(piece.encode("utf-8", "replace")), np.int32).tobytes()
        return value

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        pieces, known = pieces_of(text), self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            return b"".join([known[p] if p in known else self._piece(p) for p in pieces])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes behind ``ids``: one gather from the joined tokens by their offsets."""
        starts, sizes = self.offsets[ids], self.offsets[np.asarray(ids) + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[index].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, made once in each worker."""
    return Encoder(path)
