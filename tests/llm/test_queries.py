"""The queries run on the smallest tables and have the columns that are asked for."""

import os

import pytest

from siltbed.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {"p3_found": ["block_id", "pii_type"], "p4_found": ["tbl", "row_id"], "p5_found": ["block_id", "lang"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(map(tuple, rows)))
    assert rows or name in COLUMNS
