"""Every registered query against its SQL."""

import pytest

import terrapyr.plans.catalogue  # noqa: F401
from terrapyr.registry import QUERIES, SQL

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    assert name in SQL
    got = QUERIES[name](spark, sf_dir)
    assert_same(got, duck.execute(SQL[name]))
    assert got.limit(1).count() == 1  # equal and empty would say nothing
