"""Every registered query of the integrity engine equals its DuckDB SQL."""

import pytest

from candela.plans import registry
from oracle import assert_equal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert_equal(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
