import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import history
from lodestrata.llm.history import History
from lodestrata.llm.textkeys import phrases, words_of
from lodestrata.operators.components import connected_components
from lodestrata.tables import scratch_path

NOUNS = [f"{a}{b}" for a in ("gar", "mol", "tes", "vin", "ker", "pad", "sol", "rim") for b in ("den", "top", "ver", "nal", "fis", "cor", "lup", "mat")]


def sentence(rng):
    return " ".join(rng.choice(NOUNS) for _ in range(12)).capitalize() + "."


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(sentence(rng) for _ in range(6)) for _ in range(n)]
    rows = list(texts)
    for k, t in enumerate(texts[:20]):
        parts = t.split(". ")
        edited = [t.upper(), "<p>" + t.replace(". ", ".</p>\n<p>") + "</p>", "[hm session:1 src:x event:save] " + t, ". ".join(parts[1:2] + parts[:1] + parts[2:]), t[: int(len(t) * 0.88)], t.replace(" ", " ", 3) + "\n\n--\nSaved from the phone"][k % 6]
        rows.append(edited)
    rows += [texts[3]] * 4
    return [(i + 1, t) for i, t in enumerate(rows)]


def brute(rows):
    seen, classes = [], {}
    for i, t in rows:
        grams = history.word_pairs(" ".join(words_of(t))) or {t.strip()}
        match = [j for j, g in seen if len(g & grams) >= history.SAME * len(g | grams)]
        classes[i] = classes[match[0]] if match else i
        seen.append((i, grams))
    return classes


def test_every_copy_is_found(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, content string")
    got = {r.id: r.class_id for r in History(spark, scratch_path(spark, "t")).admit(df).collect()}
    assert got == brute(rows)
    assert sum(a != b for a, b in got.items()) == 24


def test_batches_give_what_one_batch_gives(spark):
    rows = corpus(2)
    index = History(spark, scratch_path(spark, "t"))
    got = {}
    for part in (rows[:30], rows[30:70], rows[70:]):
        got |= {r.id: r.class_id for r in index.admit(spark.createDataFrame(part, "id long, content string")).collect()}
    assert got == brute(rows)


def test_a_crowd_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(history, "CROWDED", 8)
    rng = random.Random(4)
    base = " ".join(sentence(rng) for _ in range(7)).split()
    rows = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i + 1, " ".join(words)))
    rows += [(i + 100, t) for i, t in corpus(5, 20)]
    df = spark.createDataFrame(rows, "id long, content string")
    got = {r.id: r.class_id for r in History(spark, scratch_path(spark, "t")).admit(df).collect()}
    assert got == brute(rows)
    assert all(got[i] == 1 for i in range(1, 41))


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "!!!"), (5, "!!!"), (6, "one"), (7, "One"), (None, "one"), (6, "one"), (8, "word " * 30000), (9, "word " * 30000)]
    df = spark.createDataFrame(rows, "id long, content string").selectExpr("*", "'x' AS key", "1 AS words")
    got = {r.id: r.class_id for r in History(spark, scratch_path(spark, "t")).admit(df).collect()}
    assert got == {4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8}
    empty = spark.createDataFrame([], "id long, content string")
    assert History(spark, scratch_path(spark, "t")).admit(empty).count() == 0


def test_an_index_is_opened_again(spark):
    rows = corpus(3)
    folder = scratch_path(spark, "t")
    got = {}
    for part in (rows[:40], rows[40:]):
        index = History(spark, folder)
        got |= {r.id: r.class_id for r in index.admit(spark.createDataFrame(part, "id long, content string")).collect()}
    assert got == brute(rows)
    assert len(History(spark, folder).batches) == 2


def test_a_later_bridge_changes_no_earlier_class(spark):
    rng = random.Random(8)
    words = [f"{rng.choice(NOUNS)}{k}" for k in range(60)]
    other = words[:30] + [f"new{k}" for k in range(30)]
    bridge = words[:45] + [f"new{k}" for k in range(15, 30)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(bridge))]
    got = {r.id: r.class_id for r in History(spark, scratch_path(spark, "t")).admit(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert got == brute(rows) and got[2] == 2


def test_common_footers_bring_no_comparisons(spark):
    rng = random.Random(9)
    footer = " ".join(f"footer{k}" for k in range(60))
    rows = [(i + 1, " ".join(f"{rng.choice(NOUNS)}{rng.randrange(5000)}" for _ in range(32)) + " " + footer) for i in range(1600)]
    texts = history.vectors(spark.createDataFrame(rows, "id long, content string"))
    cells = history.cells(texts, history.rarity(texts)).withColumn("limit", F.col("id"))
    assert history._met(cells, cells, ["cell"]).count() < 50_000


@pytest.mark.parametrize("seed", range(12))
def test_copies_meet_in_a_cell(seed):
    """What is near shares a cell of both, with enough weight left from its first one on."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(1, 19, 1 << history.BUCKET_BITS).astype(np.uint8)
    for n in range(1, 120):
        a = rng.integers(0, 2**64, n, np.uint64)
        b = a.copy()
        b[rng.choice(n, rng.integers(0, 1 + n // 6), False)] = rng.integers(0, 2**64, dtype=np.uint64)
        row, found, weights = history.weighted(np.concatenate([a, b]), np.array([n, n]), bits)
        whole, left = history.left_from(row, weights, 2)
        (x, v), (y, w) = ((found[row == k], weights[row == k]) for k in (0, 1))
        shared = set(x.tolist()) & set(y.tolist())
        common = sum(int(k) for c, k in zip(x.tolist(), v) if c in shared)
        if not common or common < history.NEAR * (v.sum() + w.sum() - common):
            continue
        px, py = (found[(row == k) & (left >= history.NEAR * whole[row])].tolist() for k in (0, 1))
        meet = [c for c in px if c in py]
        assert meet
        rest = min(v[px.index(meet[0]) :].sum(), w[py.index(meet[0]) :].sum())
        assert rest >= history.NEAR / (1 + history.NEAR) * (v.sum() + w.sum()) - 1e-6


def test_an_edit_changes_few_phrases():
    w = np.random.default_rng(1).integers(0, 2**64, 600, np.uint64)
    edited = w.copy()
    edited[300] += np.uint64(1)
    n = np.array([600])
    a, b = phrases(w, n)[1], phrases(edited, n)[1]
    assert len(np.setdiff1d(a, b)) <= 4 and phrases(w, n)[2].sum() <= 600


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000), (1000, 1000), (None, 4)] + [(2000, 2000 + i) for i in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
