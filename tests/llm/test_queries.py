"""Registered queries next to their SQL, where SQL can say them."""

import os

import pytest

from compare import connect, difference
from replyforest.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == ""
