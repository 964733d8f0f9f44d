"""Every query that has SQL gives the rows of its SQL, at the smallest size."""

import duckdb
import pytest

from factloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int | float) or type(value).__name__ == "Decimal":
        return f"{float(value) + 0.0:.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    frame = catalog.queries()[name](spark, SMALL)
    result = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(result.columns)
    assert sorted(frame.columns) == columns
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = sorted(tuple(plain(r[result.columns.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs and (ours or name == "none")


def test_catalog_is_consistent():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert "q07_balance_check" in catalog.queries()
