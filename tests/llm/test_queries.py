"""The registered queries of the subpackage, beside their SQL where there is one."""

import os

import pytest

import __spark_entry__ as entry
from kindred.llm.queries import oracle_sql, queries
from tests.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")

COLUMNS = {
    "p1_found": ["keep_id", "copy_id"], "p2_found": ["id_1", "id_2"], "p3_found": ["id_1", "id_2", "field_name"], "p4_found": ["token", "mark"],
    "p6_found": ["query_id", "pair_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


def test_registered():
    assert set(queries()) <= set(entry.queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    said, ok = compare(spark, FOLDER, name, oracle_sql()[name])
    assert ok, said


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_single_rows(spark, name):
    df = queries()[name](spark, FOLDER)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))
