import pytest

from gridscale.plans import registry

from .oracle import connect, difference

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""
