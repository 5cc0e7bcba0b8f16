"""Corpus queries against their reference SQL, whole tables, smallest scale."""

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, queries
from feedsift.llm.oracles import llm_oracles
from feedsift.llm.scratch import importable


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query(spark, name):
    importable(spark)
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE_DIR}/{table}.parquet'")
    frame = queries()[name](spark, SMOKE_DIR)
    columns = sorted(frame.columns)
    result = connection.execute(llm_oracles()[name])
    names = [d[0] for d in result.description]
    wanted = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(repr, map(tuple, frame.select(columns).collect()))) == sorted(map(repr, wanted))
