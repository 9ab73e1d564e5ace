"""Every registered query against its SQL on the small tables."""

import os

import pytest

from strandloom.catalog import all_queries, all_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    from compare import database

    return database(SF_DIR)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    from compare import difference, types

    df = all_queries()[name](spark, SF_DIR)
    sql = all_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert df.count() > 0
        assert difference(df, con, sql) == ""
        assert types(df, con, sql) == {}
