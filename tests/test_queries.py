"""Every registered query beside its SQL, over whole tables."""

import os

import pytest
from compare import ORACLES, QUERIES, check, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    check(spark, con, name, SF)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
