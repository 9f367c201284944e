"""Every registered query against its SQL, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pandas as pd
import pytest

spec = importlib.util.spec_from_file_location("entry", Path(__file__).parent.parent / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

FOLDER = Path("/root/testdata/sf0.001")
SQL = entry._oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name in entry._queries()}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in FOLDER.glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table}'")
    return connection


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else str(v) for v in row) for row in frame.itertuples(index=False))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, database, name):
    ours, theirs = QUERIES[name](spark, str(FOLDER)).toPandas(), database.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0 and rows_of(ours) == rows_of(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 9
