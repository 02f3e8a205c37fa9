import os

import pytest

from tessitura.llm.queries import ORACLE, QUERIES
from tests.oracle import SF, compare

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
COLUMNS = {
    "p1_found": [("rec_id", "bigint"), ("kind", "string")],
    "p4_found": [("kind", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p5_found": [("rec_id", "bigint"), ("speaker_idx", "int"), ("first_seg_id", "bigint"), ("last_seg_id", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.dtypes == COLUMNS[name]
    df.count()
