import os

import pytest

from tessitura import queries_core, registry
from tests.oracle import SF, compare

QUERIES = registry.QUERIES | queries_core.QUERIES
ORACLE = registry.ORACLE | queries_core.ORACLE
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
