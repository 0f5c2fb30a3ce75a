"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from risingtide.catalogue import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        value = value.date()
    return repr(value + 0.0 if isinstance(value, float) else value)


def shown(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert shown(got.columns, got.collect()) == shown(columns, want.fetchall())


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["date", "type", "name", "rank_count"]
    # Further names come from the optional subpackage and its pipeline alone.
    assert QUERIES.items() <= contract.queries().items() and ORACLES.items() <= contract.oracle_sql().items()
    assert contract.queries().keys() - QUERIES.keys() == contract.EXTRA_QUERIES.keys()
    assert all(name == "pipeline" or name.startswith("op") for name in contract.EXTRA_QUERIES)
    assert contract.oracle_sql().keys() <= contract.queries().keys()
