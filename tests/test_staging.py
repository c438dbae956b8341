"""Staged tables go with their block."""

import os

from candela.plans import feed_queries
from candela.session import shared_folder, staged, staging


def test_a_block_deletes_what_it_staged_and_no_more(spark):
    kept = staged(spark.range(3), "kept")
    with staging(spark) as folder:
        own = staged(spark.range(5), "own")
        with staging(spark) as inner:
            staged(spark.range(2), "inner")
            assert os.path.isdir(inner)
        assert not os.path.exists(inner) and own.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 3
    with staging(spark) as empty:
        pass
    assert not os.path.exists(empty)


def test_an_import_keeps_its_tables_and_nothing_that_it_staged(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert feed_queries.import_job(spark, "/root/testdata/sf0.001").where("part = 'claims'").count() > 0
    assert [name.split("-")[0] for name in set(os.listdir(folder)) - before] == ["import"]
