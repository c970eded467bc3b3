"""Every core query with a DuckDB statement gives the same rows; the others run."""

import os

import pytest

from foliomill.plans import catalog
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query = catalog.queries()[name]
    if name in catalog.oracle_sql():
        oracle.same(spark, query, catalog.oracle_sql()[name], FOLDER, con)
    else:
        assert query(spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
