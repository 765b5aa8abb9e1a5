"""Every registered query against its SQL check on the smallest scale directory."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry
from stewardspark.workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    result = compare(spark, con, key, SF)
    assert result["ok"], result["problems"]
