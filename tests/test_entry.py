"""The driver's contract."""

import __spark_entry__ as entry
from helixpath.plans import catalog


def test_queries_and_sql_have_the_same_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert all(callable(q) for q in queries.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "result"] and df.count() > 0
