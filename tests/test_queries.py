"""Every registered query against its SQL, on the smallest driver tables."""

import oracle
import pytest

from __spark_entry__ import entry
from docforge.plans.oracles import ORACLES
from docforge.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    got = oracle.spark_result(QUERIES[name](spark, FOLDER))
    want = oracle.sql_result(db, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "an empty result checks nothing"


def test_entry_returns_documents(spark):
    documents = entry(spark)
    assert documents.columns == ["movie_id", "title", "doc_text", "content_hash", "review_count", "char_length"]
    assert documents.count() > 0
