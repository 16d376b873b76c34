"""Registered queries against their SQL twins, where SQL can express them."""

from __future__ import annotations

import pytest
from compare import connect, difference

from tripline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert difference(spark, connect(SF), QUERIES[name], SQL[name], SF) is None
