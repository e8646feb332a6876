"""Every query that has a SQL counterpart gives the same rows on the smallest tables."""

import pytest
from compare import difference

from corpusgauge.plans.oracles import ORACLES
from corpusgauge.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    assert difference(spark, SF, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
