"""Every query with a SQL twin gives the same rows as that SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def text(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [part[0] for part in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, name):
    """The whole result is computed and goes nowhere."""
    df = entry.queries()[name](spark, str(SF))
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["k", "idx", "n"] and rows.count() == 942
