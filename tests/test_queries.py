"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registered
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')"
        )
    yield connection
    connection.close()


def ordered(records):
    return sorted(records, key=lambda record: [(cell is None, str(cell)) for cell in record])


@pytest.mark.parametrize("name", registered.oracle_sql())
def test_query(spark, database, name):
    found = registered.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    records = [tuple(row[c] for c in columns) for row in found.collect()]
    answer = database.execute(registered.oracle_sql()[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == columns
    wanted = [tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()]
    assert records
    assert ordered(records) == ordered(wanted)


def test_entry(spark):
    flagship = registered.entry(spark)
    assert flagship.columns[:2] == ["doc_id", "TITLE"]
    assert flagship.count() > 0
