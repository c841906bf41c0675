"""Every query of the llm problems on the smallest tables."""

import pytest

from tidemark.llm import queries

DIR = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["first_id", "candidate_id"], "p3_found": ["candidate_id", "field"], "p6_found": ["id_a", "id_b"],
    "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows or name.startswith("p8")
    if name in FOUND:
        assert df.columns == FOUND[name]
        keys = [tuple(r)[:1] if name == "p7_ids" else tuple(r) for r in rows]
        assert len(set(keys)) == len(keys)
