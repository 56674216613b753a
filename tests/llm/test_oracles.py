"""Operators against their oracle SQL on the smallest tables."""

import pytest
from tests.compare import same
from tests.conftest import SF
from waypost.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(name, spark, duck):
    same(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name])
