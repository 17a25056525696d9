"""Every registered query with an SQL counterpart gives the same table in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_result(spark, sf_dir, con, name):
    frame = entry.queries()[name](spark, sf_dir)
    assert differences(frame, con, entry.oracle_sql()[name]) == []
