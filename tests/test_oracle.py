import pytest

from exonloom.plans import registry
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert_same(spark, connect(sf), sf, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["model_comparison", "top_features"])
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
