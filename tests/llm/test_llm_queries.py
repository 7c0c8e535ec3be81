"""Every query of this subpackage on the smallest tables: against its SQL, or for its columns and repeated rows."""

import os

import pytest
from compare import check, connect

from lexweave.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
FOUND = {
    "p1_found": ["case_id_a", "case_id_b"],
    "p2_found": ["pdf_id", "page_number", "line_no", "kind"],
    "p3_found": ["pdf_id", "chunk_id", "mention_no", "statute_id"],
    "p4_found": ["case_id", "para_id", "sent_start"],
    "p6_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        check(df, connect(FOLDER), queries.ORACLES[name])
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in FOUND:
        assert df.columns == FOUND[name]
