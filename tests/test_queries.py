"""Every core query against its SQL on the smallest tables; queries without SQL have to run."""

import pytest

from lectern.plans.queries import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data)
    if name in ORACLE:
        compare(got.toPandas(), con.sql(ORACLE[name]).df())
    else:
        assert got.count() >= 0
        assert len(set(got.columns)) == len(got.columns)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
