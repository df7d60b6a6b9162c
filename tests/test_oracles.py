"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from stripweave.plans import ORACLES, QUERIES
from stripweave.sources.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    return str(x)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted([plain(row[i]) for i in at] for row in result.fetchall())
    got = sorted([plain(x) for x in row] for row in frame.select(*columns).collect())
    assert got == want and got
