"""The text queries against their SQL; those without SQL have to run with the columns they promise."""

import pytest

from lectern.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

COLUMNS = {
    "p1_found": ["chunk_id_a", "chunk_id_b"],
    "p2_found": ["transcript_id", "turn_no", "speaker_id", "first_seg_id", "last_seg_id"],
    "p3_found": ["item_a", "item_b"],
    "p4_found": ["record_kind", "record_id", "delegate_id"],
    "p5_found": ["chunk_id", "line_no", "defect"],
    "p6_found": ["chunk_id"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]
    if name in ORACLE:
        compare(got.toPandas(), con.sql(ORACLE[name]).df())
    else:
        assert got.count() > 0
