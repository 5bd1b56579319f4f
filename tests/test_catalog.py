"""Every registered query against its SQL equivalent, at the smallest scale."""

import os

import pytest

from packetlens.plans.all_queries import CATALOG
from tests.compare import connect, difference

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    os.environ["ALLOW_EMPTY"] = "1"
    yield connect(SF)
    del os.environ["ALLOW_EMPTY"]


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_equals_sql(spark, con, name):
    q = CATALOG[name]
    df = q.plan(spark, SF)
    if q.sql is None:
        df.count()
    else:
        assert difference(df, con, q.sql) is None
