import pytest

from quarrymill.llm.queries import QUERIES, SQL
from tests.compare import SF, duck, rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_in_sql(spark, name):
    assert rows(QUERIES[name](spark, SF)) == duck(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
