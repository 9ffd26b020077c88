"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from kindred.plans import catalogue
from tests.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.SQL) == set(catalogue.oracle_sql())
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() == 50


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    said, ok = compare(spark, FOLDER, name, catalogue.oracle_sql()[name])
    assert ok, said


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"lexical_classifier_auc"}))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0


def test_stable_index_finds_nine_of_ten_true_neighbours(spark):
    folder = FOLDER.replace("0.001", "0.1")
    true, got = ({(r["query_id"], r["item_id"]) for r in catalogue.queries()[name](spark, folder).collect()} for name in ("knn_cosine", "e2lsh_nearest"))
    assert len(true & got) >= 0.9 * len(true)


def test_classifier_tells_labels_apart_no_worse_than_chance(spark):
    rows = catalogue.queries()["lexical_classifier_auc"](spark, FOLDER).collect()
    assert [r["fold"] for r in rows] == [0, 1, 2, 3, 4] and all(0.3 < r["auc"] <= 1 for r in rows)
