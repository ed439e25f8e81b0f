"""Every query that has SQL says what the SQL says, over whole tables."""

import datetime

import duckdb
import pytest

from loomtrace.plans import payload_queries  # noqa: F401  registers its queries
from loomtrace.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, data, sql, name):
    df, want = QUERIES[name](spark, data), sql.sql(ORACLES[name])
    got = rows(df.columns, map(tuple, df.collect()))
    assert got == rows(want.columns, want.fetchall())
    assert got[1] or name == "anti_no_error"  # no session may be without errors in a small table


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
