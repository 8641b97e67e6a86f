"""Queries that SQL can express, against their SQL."""

import pytest

import oracle
from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", queries.SQL)
def test_query(spark, con, name):
    report, expected = oracle.differences(queries.QUERIES[name](spark, SF), queries.SQL[name], con)
    assert not report and expected, report
