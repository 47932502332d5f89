"""Registered queries against their SQL, and that every operator is registered."""

import oracle
import pytest

from docforge.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(small):
    return oracle.connect(small)


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, small, name):
    got, want = oracle.spark_result(QUERIES[name](spark, small)), oracle.sql_result(db, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]
