"""Every training query over the smallest tables; SQL where it exists."""

import pytest

from lodestrand.llm import queries
from tests.oracle import connect, normal


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    got = queries.queries()[name](spark, small).toPandas()
    assert len(got) and not got.astype(str).duplicated().any()
    if name in queries.oracle_sql():
        want = connect(small).execute(queries.oracle_sql()[name]).df()
        assert normal(got).equals(normal(want))
