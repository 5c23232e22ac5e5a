import pytest
from compare import connect, same

from quarry.plans import registry

QUERIES, ORACLE = registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert same(QUERIES[name](spark, SF), ORACLE[name], con) > 0
