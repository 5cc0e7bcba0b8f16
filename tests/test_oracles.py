"""Every registered query against its reference SQL, whole tables, smallest scale."""

import math

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry
from feedsift.plans.oracles import all_oracles
from feedsift.plans.queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE_DIR}/{table}.parquet'")
    return connection


def same_form(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(same_form(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(shaped, key=repr)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMOKE_DIR)
    result = duck.execute(ORACLES[name])
    expected = table([d[0] for d in result.description], result.fetchall())
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == expected
    assert expected[1]


def test_whole_list_comes_in_rank_order(spark, duck):
    got = [r["seq"] for r in QUERIES["rank_rows"](spark, SMOKE_DIR).collect()]
    ordered = ORACLES["rank_rows"].rsplit("SELECT", 1)[0] + "SELECT seq FROM ordered ORDER BY rank_no"
    assert got == [r[0] for r in duck.execute(ordered).fetchall()]


def test_entry(spark):
    assert entry(spark).count() > 0
