from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.splitting import locate, split_long, split_records, split_text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,é́😀\r", max_size=900), st.integers(20, 120), st.integers(0, 15), st.sampled_from([None, 150]))
def test_pieces_cover_within_limits(text, limit, overlap, max_bytes):
    pieces = split_text(text, limit, overlap, max_bytes)
    if not text:
        assert pieces == []
        return
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert 0 < p.end - p.start <= limit and (max_bytes is None or len(text[p.start : p.end].encode()) <= max_bytes)
    for a, b in zip(pieces, pieces[1:]):
        assert a.start < b.start <= a.end < b.end
    if len(text) <= limit and max_bytes is None:
        assert len(pieces) == 1


def test_cuts_at_paragraphs_with_overlap():
    text = "\n\n".join(("Sentence number %d stands here. " % i) * 8 for i in range(30))
    pieces = split_text(text, 2000, 200)
    assert len(pieces) <= -(-(len(text) - 200) // 1800) + 1
    assert all(p.boundary in ("paragraph", "end") for p in pieces)
    assert all(100 <= a.end - b.start <= 300 for a, b in zip(pieces, pieces[1:]))


def test_without_boundaries_characters_stay_whole():
    text = "é" * 3000
    pieces = split_text(text, 1001, 100)
    assert all(p.start % 2 == 0 and (p.end % 2 == 0) for p in pieces)


def test_locate():
    assert locate("bc", "abcabc", 4, None) == 4 and locate("bc", "abcabc", 5, None) == 4 and locate("bc", "abcabc", None, 3) == 1
    assert locate("zz", "abc", 0, 2) is None and locate("a", None, 0, 1) is None


def test_records(spark):
    long = "One two three. " * 300
    rows = [("f", 1, long, None, None, None), ("c", 2, long[30:3030], long, 30, None), ("c", 3, long[30:3030], long, 45, 9), ("c", 4, "y" * 2500, "no", 0, 2500), ("f", 5, None, None, None, None), ("f", 6, "", None, None, None), ("f", 7, "short", None, None, None)]
    schema = "src_field string, row_id long, text string, content string, char_start long, char_end long"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS piece", "'b' AS boundary")
    got = split_records(df).collect()
    by = {k: sorted((r.piece, r.char_start, r.char_end, r.text) for r in got if r.row_id == k) for k in range(1, 8)}
    assert [len(by[k]) > 1 for k in range(1, 8)] == [True, True, True, True, False, False, False] and not by[5] and not by[6] and by[7] == [(0, 0, 5, "short")]
    for k in (1, 2, 3):
        assert all(long[s:e] == t and len(t) <= 2000 for _, s, e, t in by[k])
    assert by[2][0][1] == 30 and all(s is None for _, s, _, _ in by[4])
    assert split_long(spark.createDataFrame([], schema)).count() == 0
