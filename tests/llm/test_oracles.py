"""Every query of the package that has SQL, against it."""

from __future__ import annotations

import pytest

from slimlake.llm import queries
from tests.compare import compare, duck
from tests.llm import shared


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duck(shared.SF)
    assert compare(spark, con, shared.SF, name, queries.QUERIES[name], queries.ORACLES[name]) is None
