"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

from tripline.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    assert difference(spark, con, queries()[name], oracle_sql()[name], SF) is None
