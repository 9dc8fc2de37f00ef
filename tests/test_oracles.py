"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from awardlake.checks import load
from tools.compare import compare, duck

SF = os.environ.get("AWARDLAKE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF)[2] == "ok"
