"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry_points
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_of_the_triage_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, duck, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    assert differences(result, duck, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() == 200
