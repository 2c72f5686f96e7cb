import os

import pytest

import __spark_entry__ as entry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")
PAIRS = [(n, q, m.ORACLE.get(n)) for m in entry.PLANS for n, q in m.QUERIES.items()]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.DATA)


@pytest.mark.parametrize(("name", "query", "sql"), PAIRS, ids=[p[0] for p in PAIRS])
def test_query_matches_its_sql(spark, con, name, query, sql):
    if sql is None:
        assert query(spark, oracle.DATA).columns
    else:
        oracle.assert_same(spark, con, query, sql, oracle.DATA)


def test_entry_has_every_query():
    assert {p[0] for p in PAIRS} <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
