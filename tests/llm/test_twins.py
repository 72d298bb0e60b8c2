import pytest

from tests.oracle import same
from waymark.llm import registry


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql_twin(spark, name, sf):
    path = f"/root/testdata/{sf}"
    same(registry.queries()[name](spark, path), registry.oracle_sql()[name], path)
