"""Every library query against its SQL twin; those without one must give a stable schema and rows."""

import pytest

from chronofold.plans import registry
from tests.compare import assert_same

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, sf, duck):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], duck)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf):
    a, b = registry.QUERIES[name](spark, sf), registry.QUERIES[name](spark, sf)
    assert a.schema == b.schema
    a.count()
