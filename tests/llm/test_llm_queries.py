"""The llm queries against their SQL."""

import pytest

from sqlcheck import same
from statelog.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES, queries.SQL, name)
