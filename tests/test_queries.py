"""Every core query runs; those with SQL equal it."""

import pytest

from tests.oracle import same
from wardline.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, small):
    same(QUERIES[name], SQL[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, small):
    rows = QUERIES[name](spark, small)
    assert rows.columns and rows.limit(1).count() == 1
