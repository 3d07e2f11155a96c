import pytest
from oracle import assert_same

from curatrix.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted({*registry.QUERIES} - {*registry.ORACLES}))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
