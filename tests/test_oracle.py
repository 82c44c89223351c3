"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from cellweave.plans import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    wrong, rows, _ = compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], small)
    assert not wrong
    assert rows > 0


def test_every_query_without_sql_gives_rows(spark, small):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, small).count() > 0, name
