"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lexloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return [columns, *sorted([value(v) for v in row] for row in frame[columns].astype(object).itertuples(index=False))]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER).toPandas()
    assert canonical(got) == canonical(duck.execute(catalogue.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
