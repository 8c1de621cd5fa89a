"""Every query of the library proper against its SQL."""

import pytest

from lamina.plans import registry
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    same(got, duck.execute(sql).df())
