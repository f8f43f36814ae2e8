import pytest

from docspark.plans import documents  # noqa: F401  (adds its queries)
from docspark.plans.queries import QUERIES, SQL
from tests.conftest import SF
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
