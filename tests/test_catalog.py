import parity
import pytest

from graphloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_parity(spark, con, name):
    if name not in catalog.ORACLES:
        assert catalog.QUERIES[name](spark, SF).count() > 0
        return
    assert parity.differs(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) is None


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
