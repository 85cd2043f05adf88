"""Every registered query against its SQL, and the driver contract."""

import __spark_entry__ as registered
import pytest
from cardwatch.plans import catalog
from compare import connection, differences


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, sf, con, name):
    frame = registered.queries()[name](spark, sf)
    assert differences(frame, con, registered.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    assert registered.entry(spark).count() == 1000


def test_every_query_has_sql_and_no_sql_is_left_over():
    from cardwatch.plans import oracle

    assert set(oracle.SQL) == set(catalog.queries())
    assert set(catalog.queries()) <= set(registered.queries())
