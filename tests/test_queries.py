"""Every registered query against its oracle on the smallest test tables, plus streams against batches."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, FOLDER, name)
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_name_queries_only():
    assert set(oracle_sql()) <= set(queries())


def test_texts_are_written_in_as_many_parts_as_their_size_needs(spark):
    """The text files of source_lines_ranges: no fixed number, so no task reads a fixed share of all documents."""
    import glob
    from __spark_entry__ import queries
    from scanloom.session import shared_dir
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    where = shared_dir(spark).removeprefix("file:") + "/scanloom/texts-*"
    before = set(glob.glob(where))
    try:
        for k, v in zip(held, ("12", "16k", "1k")):
            spark.conf.set(k, v)
        queries()["source_lines_ranges"](spark, "/root/testdata/sf0.001")
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    (folder,) = set(glob.glob(where)) - before
    assert len(glob.glob(folder + "/part-*")) > 4
