import pytest

import oracle
from lexgrain.llm import registry

COLUMNS = {
    "p1_found": ["chunk_id", "field_name"], "p2_found": ["chunk_id", "noise_kind"], "p3_found": ["document_id", "field_name", "ref_id"], "p4_found": ["chunk_id_a", "chunk_id_b"], "p5_found": ["document_id", "chunk_id"],
    "p6_found": ["chunk_id_a", "chunk_id_b"], "p7_found": ["query_id", "chunk_id"], "p8_found": ["doc_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_no_repeats(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, folder, name):
    assert oracle.difference(spark, folder, registry.queries()[name], registry.oracle_sql()[name]) == ""
