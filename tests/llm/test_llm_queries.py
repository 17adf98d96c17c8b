import pytest

from genoloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, compare):
    compare(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(name, spark):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
