import pytest

from tests.oracle import same
from waymark.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that need more rows: at the smallest size no trip stands at the audited moment, so mutants of standing trips have no case.
LARGER = {"Q1_leak_harness": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql_twin(spark, name):
    sf = LARGER.get(name, SF)
    same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    registry.queries()[name](spark, SF).count()
