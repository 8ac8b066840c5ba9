"""Every registered corpus query runs over its whole smallest tables, and twice alike where it is cheap to ask."""

import os

import pytest

from mnemora.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["rec_table", "rec_id", "seg", "lang"],
    "p4_found": ["rec_table", "rec_id", "kind", "start_pos"],
    "p6_found": ["request_id", "pos"],
    "p7_found": ["node_a", "node_b"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "category"],
}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(map(repr, r)) for r in df.collect()]
    assert rows or name == "p10_found"  # some ten ratings name nothing for certain
    if name.endswith("_found") or name == "p8_ids":
        assert len(set(rows)) == len(rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_confidence_is_a_share(spark):
    got = [r.confidence for r in queries.p1_segments(spark, DIR).collect()]
    assert got and all(0 <= c <= 1 for c in got)
