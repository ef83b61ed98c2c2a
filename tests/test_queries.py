"""Every registered query against its SQL, on the smallest tables in which it finds something."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connect

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return {sf: connect(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    for sf in (SF, LARGER):  # the larger tables where nothing is found in the smallest
        problem = compare(spark, con[sf], sf, entry_points.queries()[name], entry_points.oracle_sql().get(name))
        if problem != "agrees, but empty":
            break
    assert problem is None, problem


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
