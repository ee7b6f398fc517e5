import pytest

from quarrymill.plans import registry
from tests.compare import SF, duck, rows


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_as_in_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, SF)) == duck(registry.SQL[name])
