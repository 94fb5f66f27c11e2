"""Right documents among the hits, where one mind and language holds most documents: against DuckDB, without all their pairs."""

import re

import duckdb
import pytest

from lodestrata import catalog


@pytest.mark.parametrize("name", ["precision_at_3", "recall_at_5"])
def test_only_hits_are_judged(spark, tmp_path, name):
    at = str(tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute("""CREATE TABLE documents AS SELECT i AS doc_id, CASE WHEN i % 9 > 0 THEN 'word' || i % 7 || ' other' || i % 11 END AS title, 'word' || i % 7 || ' other' || i % 11 || ' more' || i % 5 AS text,
        CASE WHEN i % 8 = 4 THEN NULL WHEN i % 4 = 0 THEN 'm' || i % 3 ELSE 'm' END AS mind, CASE WHEN i % 500 > 0 THEN 'en' END AS lang FROM range(1200) t(i) UNION ALL SELECT 200, 'word1 other2', 'word1', 'm', 'en'""")
    c.execute(f"COPY documents TO '{at}' (FORMAT parquet)")
    df = catalog.queries()[name](spark, str(tmp_path))
    found = c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(found) and len(found) == 4
    assert not re.search(r"Join \[mind#\d+, lang#\d+\]", df._jdf.queryExecution().executedPlan().toString())
