import os

import pytest

from skein.llm import queries as Q
from tests.oracle import compare

SMALL = os.environ.get("SKEIN_TEST_SF", "/root/testdata/sf0.001")
FOUND = {
    "p1_found": ["annotation_id", "group_id"],
    "p2_found": ["field", "record_id", "kind"],
    "p3_found": ["annotation_id_a", "annotation_id_b"],
    "p4_found": ["conversation_id"],
    "p6_found": ["annotation_id_a", "annotation_id_b"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, name):
    compare(spark, Q.QUERIES[name], Q.ORACLE[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs_with_its_columns(spark, name):
    df = Q.QUERIES[name](spark, SMALL)
    assert df.columns == FOUND.get(name, df.columns) and df.count() >= 0
    if name in FOUND:
        assert df.count() == df.distinct().count()
