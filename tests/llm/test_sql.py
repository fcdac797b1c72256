"""Queries against their SQL on whole tables."""

import parity
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert parity.differs(queries.QUERIES[name](spark, sf), parity.connect(sf), queries.ORACLES[name]) is None
