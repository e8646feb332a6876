"""Queries and their SQL give the same rows over whole tables."""

import pytest
from compare import difference

from corpusgauge.llm.oracles import ORACLES
from corpusgauge.llm.queries import QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name, sf):
    assert difference(spark, f"/root/testdata/{sf}", QUERIES[name], ORACLES[name]) is None
