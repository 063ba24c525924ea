"""Every core query against its SQL, over the whole smallest tables."""

import pytest

from lodestrand.plans import catalog
from tests.oracle import connect, normal

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, con, name):
    got = catalog.queries()[name](spark, small).toPandas()
    if name not in SQL:
        assert list(got.columns)
        return
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got).equals(normal(want))
