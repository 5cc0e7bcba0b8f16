"""What the physical plans must and must not hold."""

import re

import pytest

from __spark_entry__ import SMOKE_DIR
from feedsift.operators import enrich, matching
from feedsift.plans import views
from feedsift.operators.columns import computed_once
from feedsift.plans.queries import all_queries
from feedsift.sources import landed
from feedsift.sources.dimension import source_dimension
from feedsift.sources.payloads import parse_pages
from pyspark.sql import functions as F

STREAMING = {
    "incremental_run", "incremental_tracker", "incremental_emails", "incremental_counters", "incremental_notices",
    "seed_run", "stream_dedup", "seen_upsert",
}
QUERIES = {n: q for n, q in all_queries().items() if n not in STREAMING}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_pairs(spark, name):
    text = plan(QUERIES[name](spark, SMOKE_DIR))
    assert not re.search(r"EvalPython|PythonUDF|InPandas|InArrow|CartesianProduct|NestedLoopJoin", text)


def exchanges(frame, kind="Exchange hashpartitioning"):
    return plan(frame).count(kind)


def test_row_wise_work_needs_no_shuffle(spark, tmp_path):
    for name in ("match_by_region", "enrich_text", "posted_age", "doc_chunks", "skill_counts"):
        text = plan(QUERIES[name](spark, SMOKE_DIR))
        assert "Exchange" not in text


def test_dedup_reduces_before_its_one_shuffle(spark):
    frame = spark.range(10).selectExpr("id AS seq", "'c' AS company", "'1' AS id", "'t' AS title")
    text = plan(matching.deduplicated(frame))
    assert text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("partial_max_by")


def test_stored_pages_are_read_narrow_and_by_format(spark, tmp_path):
    path = str(tmp_path / "p")
    dimension = source_dimension(spark)
    landed.land_pages(views.landed_pages(spark, SMOKE_DIR), dimension, path)
    text = plan(landed.collect_listings(landed.read_stored(spark, path), dimension))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PartitionFilters: \[([^\]]*)", text)
    assert len([s for s in scans if "listings" not in s[0]]) >= 1
    wide = [filters for columns, filters in scans if "listings" in columns]
    assert wide and all("ats" in filters for filters in wide)
    assert "BroadcastHashJoin" in text


def test_payloads_are_parsed_once_and_not_again(spark, tmp_path):
    path, dimension = str(tmp_path / "p"), source_dimension(spark)
    pages = landed.with_source(views.landed_pages(spark, SMOKE_DIR), dimension, "ats", "address")
    assert len(re.findall(r"from_json\(", plan(parse_pages(pages)))) == 1
    landed.land_pages(views.landed_pages(spark, SMOKE_DIR), dimension, path)
    assert "from_json" not in plan(landed.collect_listings(landed.read_stored(spark, path), dimension))


def test_the_best_rows_need_one_dedup_and_one_set_of_patterns(spark):
    text = plan(QUERIES["digest_parts"](spark, SMOKE_DIR))
    assert text.count("Generate inline") == 2  # the view that stands for a table, and the signals
    assert text.count("Exchange hashpartitioning(listing_key") == 1


def test_only_needed_columns_are_scanned(spark):
    text = plan(QUERIES["posted_age"](spark, SMOKE_DIR))
    assert "ReadSchema" in text and "o_custkey" not in text and "o_orderpriority" not in text
    assert "props" not in plan(QUERIES["seen_diff"](spark, SMOKE_DIR))


def test_signals_are_read_once_under_a_filter(spark):
    frame = spark.createDataFrame([("x",)], "description STRING")
    text = plan(enrich.with_signals(frame).where("remote AND flag_status = 'unknown'"))
    assert text.count("without(?<!") == 1


def test_computed_once_replaces_and_adds(spark):
    frame = spark.createDataFrame([(1, 2)], "a INT, b INT")
    got = computed_once(frame, {"b": F.col("a") + F.col("b"), "c": F.lit("z")})
    assert got.columns == ["a", "b", "c"] and tuple(got.first()) == (1, 3, "z")


def test_health_pairs_by_keys_alone(spark):
    text = plan(QUERIES["source_health"](spark, SMOKE_DIR))
    assert "collect_list" not in text and "NestedLoop" not in text
