"""Every registered query against its SQL at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from oracle.queries import oracle_sql
from standtally.catalog import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal) and v == int(v):
        return str(int(v))
    return None if v is None else str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(row[i]) for i in order) for row in data), key=repr)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = table(df.columns, df.collect())
    assert got == table(columns, result.fetchall())
    assert got
