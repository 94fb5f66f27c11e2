"""The registered queries on the smallest tables: their columns, and SQL where there is some."""

import os

import duckdb
import pytest

from lodestrata.llm import catalog

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": "id_a id_b", "p3_found": "src_field row_id", "p4_found": "src_field row_id pii_type", "p5_found": "first_id copy_id", "p6_ids": "doc_id ids",
    "p7_containers": "doc_id piece token_start token_end n_tokens container_id", "p8_found": "doc_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = catalog.queries()[name](spark, DATA)
    found = c.execute(catalog.oracle_sql()[name])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_runs_add_up(spark):
    rows = catalog.queries()["p5_runs"](spark, DATA).collect()
    copies = catalog.queries()["p5_found"](spark, DATA).count()
    assert sum(r.duplicates_skipped for r in rows) == copies and all(r.rows == r.accepted + r.duplicates_skipped for r in rows)
