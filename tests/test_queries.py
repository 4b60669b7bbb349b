import pytest

import __spark_entry__ as entry
from blockweave.plans import file_queries, queries, scan_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(same_rows, name):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["target_id", "base_id", "votes"]
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
