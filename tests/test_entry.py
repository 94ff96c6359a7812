"""Driver contract: entry runs at sf0.001, every query has a name-matched oracle or is rows-only."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns


def test_every_query_has_oracle():
    assert set(entry.CORE_SQL) == set(entry.CORE_QUERIES) and set(entry.CORE_QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", ["chunk_documents", "knn_cosine", "metadata_profile", "retrieval_decision"])
def test_some_queries_at_smoke_scale(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
