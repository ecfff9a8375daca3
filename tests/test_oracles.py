"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from helixpath.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(([dict(zip(names, r, strict=True))[c] for c in columns] for r in result.fetchall()), key=repr)
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=repr) == want
