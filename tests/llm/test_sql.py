import pytest

from docspark.llm import registry
from tests.conftest import SF
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)
