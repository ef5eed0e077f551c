"""Every named query of the library that has SQL, against it."""

import pytest

from chunkweave.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, name):
    compare(spark, sf, catalog.QUERIES[name], catalog.SQL[name])
