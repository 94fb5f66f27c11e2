"""Similarity joins block by block: against brute force, and without a join on trigrams."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.operators import similarity


def grams(t):
    return {t[k : k + 3] for k in range(len(t) - 2)}


def alike(a, b):
    return len(grams(a) & grams(b)) / max(len(grams(a)), len(grams(b)), 1)


def texts(n, seed):
    """Sentences of few words, so that most trigrams are in many texts; some of over 255 trigrams, of three letters, with letters beyond 16 bits."""
    rng = random.Random(seed)
    words = "amber basin cedar delta ember fjord grove heath inlet jetty".split() + ["".join(rng.choice("klmnopqrstuv\U0001f600") for _ in range(40)) for _ in range(12)]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 6, 30)))) for _ in range(n)]
    return [*out, *(t[:-3] + "xyz" for t in out[::3]), "abc", "ab"]


@pytest.mark.parametrize("least", [0.4, 0.75])
def test_against_brute_force(spark, least):
    a, b = sorted(set(texts(60, 1))), sorted({*texts(90, 2), *(t + " end" for t in texts(60, 1)[::2])})
    frame = lambda t, at: spark.createDataFrame([*enumerate(t, at)], "id long, text string").repartition(3)
    want = {(i, j): alike(x, y) for i, x in enumerate(a) for j, y in enumerate(b, 1000) if alike(x, y) >= least}
    df = similarity.against(frame(a, 0), frame(b, 1000), least)
    assert {(r.a, r.b): r.similarity for r in df.collect()} == want and len(want) > 20
    assert "code" not in df._jdf.queryExecution().executedPlan().toString()
    small = similarity._compared(frame(a, 0), frame(b, 1000), least, "best", block=7)
    best = {}
    for r in sorted(small.collect(), key=lambda r: (-r.similarity, r.b)):
        best.setdefault(r.a, (r.b, r.similarity))
    assert best == {i: min(((j, s) for (k, j), s in want.items() if k == i), key=lambda x: (-x[1], x[0])) for i in {i for i, _ in want}}


def test_copies_and_repeated_rows(spark):
    old = [(1, "Amber basin cedar"), (2, "amber  basin cedar"), (2, "amber  basin cedar"), (3, " "), (4, None), (7, "delta ember fjord grove")]
    new = [(10, "AMBER basin cedar"), (11, "delta ember fjord grov"), (11, "delta ember fjord grov"), (12, "delta ember fjord grov"), (13, ""), (14, None), (15, "no such text at all")]
    frame = lambda t: spark.createDataFrame(t, "id long, text string")
    got = {r.id: (r.action, r.match_id) for r in similarity.screened_against(frame(new), frame(old)).collect()}
    assert got == {10: ("skip", 1), 11: ("skip", 7), 12: ("skip", 7), 13: ("skip", None), 14: ("skip", None), 15: ("keep", None)}


def test_counts_of_blocks(spark):
    rows = [*enumerate(texts(80, 3)), (900, None)]
    keys = {t: min(i for i, x in rows if x == t) for t in {t for _, t in rows if t}}
    of = lambda t: [alike(t, x) for x in keys if x != t]
    want = {t: (sum(s >= 0.75 for s in of(t)), sum(0.4 <= s < 0.75 for s in of(t))) for t in keys}
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    full = similarity.links_per_text(df)
    assert {r.id: (r.class_id, r.near, r.related) for r in full.collect()} == {i: (keys[t], *want[t]) for i, t in rows if t}
    assert "code" not in full._jdf.queryExecution().executedPlan().toString()
    heads = spark.createDataFrame([(i, t) for t, i in keys.items()], "id long, text string").repartition(3)
    got = {}
    for r in similarity._compared(heads, None, 0.4, "counts", 0.75, block=9).collect():
        near, related = got.get(r.a, (0, 0))
        got[r.a] = near + r.near, related + r.related
    assert got == {keys[t]: n for t, n in want.items() if sum(n)}


def test_few_pairs_are_counted(spark, monkeypatch):
    """Texts of three languages made of few words: bounds leave few of all pairs to be counted, and lose none."""
    rng = random.Random(6)
    tongues = [["".join(rng.choice(a) for _ in range(rng.choice((5, 7, 9)))) for _ in range(60)] for a in ("abcdefghi", "jklmnopqr", "rstuvwxyz")]
    old = [" ".join(rng.choice(tongues[i % 3]) for _ in range(rng.choice((20, 30, 45)))) for i in range(900)]
    new = [" ".join(rng.choice(tongues[i % 3]) for _ in range(rng.choice((20, 30, 45)))) for i in range(150)] + [t[: -len(t) // 8] + " end" for t in old[::20]]
    frame = lambda t: spark.createDataFrame([*enumerate(t)], "id long, text string").repartition(2)
    want = {(i, j) for i, x in enumerate(new) for j, y in enumerate(old) if alike(x, y) >= 0.75}
    assert {(r.a, r.b) for r in similarity.against(frame(new), frame(old), 0.75).collect()} == want and len(want) > 30
    known = sorted({g for t in [*new, *old] for _, grams, _, _ in similarity._gram_sets([t]) for g in grams.tolist()})
    rank = np.arange(len(known), dtype=np.int32)
    held = type("Held", (), {"value": similarity._kinds(np.array(known), rank, old)})
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t)], ["id", "text"])
    x, y = (pa.Table.from_batches(similarity._kept(held, 4096, p)(iter([batch(t)]))).to_pylist() for t, p in ((new, False), (old, True)))
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda bits: counted.append(len(bits)) or count(bits))
    rows = [{"xblock": 0, "xm": x[0]["m"], "xrare": x[0]["rare"], "xdata": x[0]["data"], "ykind": b["kind"], "ym": b["m"], "yrare": b["rare"], "ydata": b["data"]} for b in y]
    found = [p for b in similarity._meeting(held, 0.75, False)(iter([pa.RecordBatch.from_pylist(rows)])) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    assert set(found) == want and len(found) == len(want)
    assert sum(counted) < len(new) * len(old) / 50


def test_texts_are_folded_once(spark):
    frame = lambda t: spark.createDataFrame(t, "id long, text string")
    told = similarity.screened_against(frame([(1, "Amber  basin"), (2, " \t")]), frame([(7, "amber basin")]))
    assert "regexp_replace" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.action, r.match_id, r.similarity) for r in told.collect()) == [(1, "skip", 7, 1.0), (2, "skip", None, None)]


def test_trigrams_of_any_letters():
    """As one number each, in order, whatever the letters; short texts have none."""
    batch = ["", "ab", "abc", "aaaa", "\U0001f600\U0001f601x\U0001f600\U0001f601x", "zß\u0000é", "abcabc" * 5]
    [(m, sets, n, of)] = similarity._gram_sets(batch)
    got = [set() for _ in batch]
    for g, t in zip(np.repeat(sets, n).tolist(), of.tolist()):
        got[t].add("".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)))
    assert m == len(batch) and got == [grams(t) for t in batch]
    assert sets.tolist() == sorted(set(sets.tolist()))
