"""Every query of the engine against the same question in SQL."""

import pytest
from compare import connect, spark_rows, sql_rows

from quarrymill.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert name in SQL
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(con, SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
