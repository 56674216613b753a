"""Every registered place query against its oracle."""

import pytest
from tests.compare import same
from tests.conftest import SF
from waypost.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(name, spark, duck):
    same(QUERIES[name](spark, SF), duck, SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("choice", ["by_default", "by_name", "free_first", "by_rating", "by_distance"])
def test_sort_choices_rank_all_places(choice, spark):
    from waypost.sources.places import places

    ranks = sorted(r.rank for r in QUERIES[f"ranked_{choice}"](spark, SF).collect())
    assert ranks == list(range(1, places(spark, SF).count() + 1))
