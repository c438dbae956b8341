"""The corpus queries that SQL can express equal their DuckDB SQL."""

import pytest

from candela.llm import registry
from oracle import assert_equal


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert_equal(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], "/root/testdata/sf0.001")
