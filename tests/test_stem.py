import math
import sqlite3

import duckdb
import pytest

from lodestrata.functions.stem import stem, stemmed_words, stemming
from lodestrata.operators.search import bm25

DATA = "/root/testdata/sf0.001"


def database():
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
        c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module here")
    return c


def test_stems_like_the_library():
    c = database()
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' WHERE lang = 'en' AND text IS NOT NULL").fetchall()]
    words = sorted({w.lower() for t in texts for w in t.split() if w.isascii() and w.isalpha()} | set("caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators".split()))
    for w in words:
        c.execute("DELETE FROM t")
        c.execute("INSERT INTO t VALUES (?)", (w,))
        assert [r[0] for r in c.execute("SELECT term FROM v")] == [stem(w)], w


def test_scores_like_the_library(spark):
    c = database()
    texts = ["The release train stops", "releases and trains, released again", "nothing of the kind", "Über the café trains", None, ""]
    for i, t in enumerate(texts, 1):
        c.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i, t or ""))
    want = {r[0]: -r[1] for r in c.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"releasing\" OR \"train\"'")}
    corpus = spark.createDataFrame([*enumerate(texts, 1)], "id long, text string")
    got = {r.id: r.score for r in bm25(spark.createDataFrame([(1, "releasing the train")], "qid long, text string"), corpus, analyzer=stemming).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)
    assert stemmed_words("Über Cafés") == ["uber", "cafe"]
