"""The registered queries that SQL expresses, on the smallest tables."""

import pytest

from careflow.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SMALL
from tests.oracle import compare, connect


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLES[name]) is None
