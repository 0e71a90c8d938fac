"""The dealt operators that SQL expresses, against their SQL twins."""

import pytest

from chronofold.llm import registry
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(name, spark, sf, duck):
    assert_same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], duck)
