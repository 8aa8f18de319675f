"""Every registered query with SQL gives the rows of its SQL; the others give rows."""

import pytest

from checks import registry
from checks.base import ORACLES, QUERIES
from checks.compare import connect, differences

registry.load()

# Its SQL names the features that survive the screening at sf0.01.
OTHER_SIZE = {"event_table_1_screened"}


@pytest.fixture(scope="module")
def sql(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in OTHER_SIZE])
def test_same_rows_as_sql(spark, sf, sql, name):
    got = QUERIES[name](spark, sf).toArrow()
    assert differences(got, sql.sql(ORACLES[name]).to_arrow_table()) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_is_the_device_table(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
