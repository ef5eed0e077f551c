"""The operators' queries that have SQL, against it."""

import pytest

from chunkweave.llm.queries import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], SQL[name])
