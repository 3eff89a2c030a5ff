"""Every query of the engine that has SQL gives the same rows in DuckDB."""

import pytest
from oracle import SF, assert_same

from stemma.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)
