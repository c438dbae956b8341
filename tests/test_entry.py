"""The driver contract holds, with or without the corpus subpackage."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_callables():
    assert all(callable(q) for q in entry.queries().values())
