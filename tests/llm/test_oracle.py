import os

import pytest

from tests.compare import DATA, compare, connect
from weftline.llm.oracle import ORACLE
from weftline.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        compare(spark, con, QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0
