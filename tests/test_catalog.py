"""Every catalogue query against its SQL check; queries without one must give rows."""

import pytest

from compare import database, differences
from plumbline.catalog import MODULES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    query = QUERIES[name]
    result = query(spark, FOLDER)
    if query.sql is None:
        assert not result.isEmpty()
    else:
        assert differences(result, con, query.sql) == []


def test_names_are_unique():
    assert len(QUERIES) == sum(len(module.QUERIES) for module in MODULES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
