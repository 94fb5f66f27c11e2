import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.bpe import encoder, pieces_of
from lodestrata.llm.packing import CAPACITY, pack, solve
from lodestrata.llm.tokens import VOCABULARY, count_tokens, decode_ids, encode_texts

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return np.frombuffer(encoder(VOCABULARY).encode(text), np.int32).tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_as_the_public_library(text):
    import public_tokenizers

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = test_same_ids_as_the_public_library.__dict__.setdefault("own", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert ids(text) == own.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20000, " " * 3000 + "x", "\x1c\x1d a\n\n  b", "abab" * 3000, "<|endoftext|>", "don't we'll I'M", "é 日本語 👩‍💻", "\r\n\r\n  x"])
def test_long_and_odd_texts(reference, text):
    assert ids(text) == reference.encode_ordinary(text)
    assert encoder(VOCABULARY).decode(np.array(ids(text), np.int64)).decode() == text
    assert "".join(pieces_of(text)) == text


def test_tables(spark):
    df = spark.createDataFrame([(1, "Hello there"), (2, ""), (3, None), (None, "Hello there"), (1, "Hello there")], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    rows = encode_texts(df, "doc_id", "text").collect()
    assert [list(r.ids) for r in rows] == [[15496, 612], [], [], [15496, 612], [15496, 612]]
    assert [r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()] == [2, 0, 0, 2, 2]
    assert [r.text for r in decode_ids(encode_texts(df, "doc_id", "text"), "doc_id").collect()] == ["Hello there", "", "", "Hello there", "Hello there"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(empty, "doc_id", "text").count() == 0
    assert pack(empty, "doc_id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25), st.integers(60, 90))
def test_patterns_hold_every_size(histogram, capacity):
    patterns = solve(histogram, capacity)
    seen = {}
    for p in patterns:
        assert p.times > 0 and sum(s * n for s, n in p.counts.items()) <= capacity
        for s, n in p.counts.items():
            seen[s] = seen.get(s, 0) + n * p.times
    assert seen == histogram
    bins, total = sum(p.times for p in patterns), sum(s * n for s, n in histogram.items())
    assert -(-total // capacity) <= bins <= 2 * -(-total // capacity)


def test_dominance_is_never_worse_than_the_optimum():
    def optimum(sizes, capacity):
        best = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for k in sorted(set(rooms)):
                if k >= sizes[i]:
                    rest = list(rooms)
                    rest[rest.index(k)] -= sizes[i]
                    place(i + 1, rest)
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes = sorted(rng.integers(3, 20, 9).tolist(), reverse=True)
        histogram = {s: sizes.count(s) for s in sizes}
        from lodestrata.llm.packing import _reduce, _Sizes

        left = _Sizes(dict(histogram))
        fixed = sum(p.times for p in _reduce(left, 20))
        rest = [s for s, n in left.count.items() for _ in range(n)]
        assert fixed + optimum(sorted(rest, reverse=True), 20) == optimum(sizes, 20)


def test_packing_of_a_table(spark):
    words = ["tree " * n for n in (1, 5, 700, 1500, 2047, 5000, 3, 3, 3, 900)]
    df = spark.createDataFrame([*enumerate(words), (50, None), (51, "")], "doc_id long, text string")
    rows = pack(df, "doc_id", "text").collect()
    loads = {}
    for r in rows:
        loads[r.container_id] = loads.get(r.container_id, 0) + r.n_tokens
        assert r.token_end - r.token_start == r.n_tokens
    counts = {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()}
    for doc, n in counts.items():
        own = sorted((r.piece, r.token_start, r.token_end) for r in rows if r.doc_id == doc)
        assert len(own) == max(1, -(-n // CAPACITY)) and own[-1][2] == n
    assert max(loads.values()) <= CAPACITY
    assert len(loads) == 6  # 1501, 905 + 901 and 701 can't share fewer than three
