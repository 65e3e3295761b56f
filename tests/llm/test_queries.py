"""Every query runs on the smallest data directory and has its columns and keys."""

import pytest

from litmill.llm.queries import QUERIES

COLUMNS = {
    "p1_found": {"paper_id_a": "int", "paper_id_b": "int"}, "p2_found": {"record_id": "bigint", "paper_id": "int"},
    "p3_found": {"entity_kind": "string", "name_a": "string", "name_b": "string"}, "p4_found": {"work_id": "string", "field_name": "string", "paper_id": "int"},
    "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)
