import itertools

import pytest

from lodestrata.llm.linking import link_names, pairs_of
from lodestrata.llm.names import blocks, edits, jaro_winkler, read_name, same_name

GROUPS = [
    ["Robert Vandermeulen", "Vandermeulen, Robert", "Bob Vandermeulen", "ROBERT VANDERMEULEN", "Robert J. Vandermeulen", "@robert.vandermeulen", "Robert Vandermuelen", 'Robert "Rob" Vandermeulen', "Dr. Robert Vandermeulen", "R. Vandermeulen", "Vandermeulen R"],
    ["Jörg Trüstelhof", "Joerg Truestelhof", "Jorg Trustelhof", "jorg_trustelhof", "Trüstelhof, Jörg"],
    ["Grimholt Insurance", "Grimholt Ins.", "The Grimholt Insurance Ltd", "Insurance, Grimholt Limited", "GrimholtInsurance", "Grimhlot Insurance", "Grimholt-Insurance", "Grimholt Insurance (Oslo)", "Grimholt Insurance & Co."],
    ["Grimholt Logistics", "Grimholt Log. GmbH", "Grimholt Logistics G.m.b.H."],
    ["Elena Vandermeulen"],
    ["Elena Grimholt", "Grimholt, Elena"],
]


@pytest.mark.parametrize("group", GROUPS)
def test_variants_are_the_same_and_share_a_block(group):
    names = [read_name(n) for n in group]
    for a, b in itertools.combinations(names, 2):
        if a.kind == b.kind and a != b:
            assert same_name(a, b) and blocks(a) & blocks(b), (a, b)


def test_others_are_different():
    for g, h in itertools.combinations(GROUPS, 2):
        for a, b in itertools.product(g, h):
            assert not same_name(read_name(a), read_name(b)) or read_name(a).kind in ("initial", "family"), (a, b)


def test_linking(spark):
    rows, truth = [], {}
    for k, group in enumerate(GROUPS):
        for n in group:
            rows.append((len(rows), n, "concept" if len(rows) % 7 == 3 else ("person" if k in (0, 1, 4, 5) else "org")))
            truth[len(rows) - 1] = k
    things = ["status board", "status board", "Project Tolmar", "Project Tolmar", "training log", "training log", "wiki compiler", "Wiki compiler", None, "", "  ", "x" * 5000]
    for n in things:
        rows.append((len(rows), n, "tool"))
    df = spark.createDataFrame([*rows, (0, "Robert Vandermeulen", "person"), (None, "Robert Vandermeulen", None)], "id long, name string, entity_type string").selectExpr("*", "'k' AS key", "1 AS node")
    got = {(r.id_a, r.id_b) for r in pairs_of(link_names(df)).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(truth, 2) if truth[a] == truth[b]}
    empty = spark.createDataFrame([], "id long, name string, entity_type string")
    assert pairs_of(link_names(empty)).count() == 0


def test_an_initial_that_fits_two_stays_alone(spark):
    rows = [(1, "Robert Vandermeulen", "person"), (2, "Rebecca Vandermeulen", "person"), (3, "R. Vandermeulen", "person"), (4, "Ms Vandermeulen", None)]
    assert pairs_of(link_names(spark.createDataFrame(rows, "id long, name string, entity_type string"))).count() == 0


def test_measures():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133 and jaro_winkler("", "a") == 0
    assert edits("abcd", "acbd") == 1 and edits("abcd", "abd") == 1 and edits("abc", "xyz") == 3 and edits("", "") == 0
