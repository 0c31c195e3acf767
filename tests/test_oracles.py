"""Every core query against its SQL on the smallest tables; the others must run."""

import pytest

from litquarry.plans import registry

from .compare import SF, rows, views

registry.load()


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    if name in registry.ORACLE:
        want = rows(con.execute(registry.ORACLE[name]).df())
        assert got == want
