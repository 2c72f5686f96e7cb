import os

import pytest

from quadrille.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")


#: Keys of the results of queries that SQL can't express; their rows are compared with brute force in the tests of their operators.
KEYS = {
    "p1_clusters": ["cluster_id"], "p3_found": ["key_a", "key_b"], "p3_neighbours": ["key", "other"], "p3_search": ["key", "other"], "p5_found": ["record_id", "field"],
    "p5_report": ["field", "defect", "model"], "p8_ids": ["doc_id"], "p9_containers": ["doc_id", "part"], "p10_found": ["doc_id"], "p10_restored": ["doc_id"],
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.DATA)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_its_sql_or_runs(spark, con, name):
    if name in queries.ORACLE:
        oracle.assert_same(spark, con, queries.QUERIES[name], queries.ORACLE[name], oracle.DATA)
    elif name in KEYS:
        rows = queries.QUERIES[name](spark, oracle.DATA).collect()
        # A result that has keys holds each of them once, and none is null.
        keys = [tuple(r[k] for k in KEYS[name]) for r in rows]
        assert rows and len(keys) == len(set(keys)) and all(k is not None for key in keys for k in key)
    else:
        raise AssertionError(f"{name} has neither SQL nor keys")
