"""One key that holds a third of all rows, or more, changes nothing and stays in small pieces."""

import re

import pytest
from pyspark.sql import functions as F

from feedsift.operators import enrich
from feedsift.operators.dedup import keep_last, unseen
from feedsift.sources import landed

N = 60_000


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    return spark.range(0, N, 1, 8).select("id", key.alias("key"), F.repeat(F.lit("x"), 50).alias("v"))


def shuffled_rows(frame):
    """Rows each exchange wrote, from the executed plan's metrics."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange":
            metrics = node.metrics()
            found.append(metrics.apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_hot_key_is_reduced_before_the_dedup_shuffle(spark, hot):
    result = keep_last(hot, ["key"], F.col("id"))
    (written,) = shuffled_rows(result)
    assert written <= N * 2 // 3 + 8
    row = result.where("key = 'hot'").first()
    assert (row["id"], row["first_seq"]) == (N - 3, 0)
    assert result.count() == N * 2 // 3 + 1


def test_hot_unit_is_reduced_before_the_status_shuffle(spark):
    pages = spark.range(0, N, 1, 8).selectExpr(
        "0L AS run_id", "CAST(IF(id % 3 = 0, 1, id) AS INT) AS source_ord", "0 AS term_no",
        "'greenhouse' AS ats", "CAST(id AS INT) AS page_offset", "1L AS n_rows",
        "CAST(NULL AS DOUBLE) AS total", "id = 30000 AS failed",
    )
    status = landed.term_status(pages)
    (written,) = shuffled_rows(status)
    assert written <= N * 2 // 3 + 8
    kept = landed.bounded_pull(pages, status)
    assert kept.count() == N
    assert kept.where("term_failed").count() == N // 3 + 1


def test_inline_rows_do_not_meet_in_the_detail_join(spark, hot):
    rows = hot.select(
        F.col("id").cast("string").alias("listing_key"), F.lit("p").alias("location"), F.lit("u").alias("url"),
        F.when(F.col("key") == "hot", "inline").alias("description"),
        F.lit("").alias("oracle_detail"), F.col("id").cast("string").alias("detail_api"),
    )
    spread_key = enrich.detail_key()
    assert rows.where(spread_key.isNull()).count() == N // 3
    details = spark.range(0, N, 2).selectExpr(
        "CAST(id AS STRING) AS detail_key", "'d' AS description", "CAST(array() AS ARRAY<STRING>) AS locations")
    got = enrich.attach_details(rows, details)
    assert got.count() == N
    assert got.where("description = 'inline'").count() == N // 3
    text = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"coalesce\(.*xxhash64", text)


def test_hot_seen_key(spark, hot):
    seen = hot.where("key = 'hot'").select("key").distinct()
    assert unseen(hot, seen, "key").count() == N * 2 // 3
