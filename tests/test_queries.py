import pytest

from compare import connection, rows_of, sql_rows
from tilewave.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    columns, got = rows_of(QUERIES[name](spark, sf_dir))
    names, want = sql_rows(con, SQL[name])
    assert columns == names
    assert got == want


def test_entry_has_rows_and_optional_parts_are_optional(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
