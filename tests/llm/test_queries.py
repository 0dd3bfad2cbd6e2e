"""Queries of the training-data operators against their SQL."""

import os

import pytest

from compare import connect, duck_rows, spark_rows
from storystream.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not found")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == duck_rows(connect(SF_DIR), ORACLES[name])
