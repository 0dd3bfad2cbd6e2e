"""Every query that has SQL agrees with it on the smallest tables; the others give rows."""

import os

import pytest

from compare import connect, duck_rows, spark_rows
from storystream.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not found")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    if name in ORACLES:
        assert (columns, rows) == duck_rows(duck, ORACLES[name])
    else:
        assert columns and rows


def test_sql_is_for_known_queries():
    assert set(ORACLES) <= set(QUERIES)
