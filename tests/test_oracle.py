import os

import pytest

from tests.compare import DATA, compare, connect
from weftline.plans import core

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    if name in core.ORACLE:
        compare(spark, con, core.QUERIES[name], core.ORACLE[name])
    else:
        assert core.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["video_id", "speaker", "src", "gap_start_ms", "gap_end_ms"]
