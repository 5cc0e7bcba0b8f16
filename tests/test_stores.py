"""Details in buckets, and texts as files."""

import re

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from feedsift.operators import enrich
from feedsift.sources.detail_store import open_details, write_details
from feedsift.sources.dimension import LISTING, read_whole_texts, write_whole_texts

DETAIL = "detail_key STRING, description STRING, locations ARRAY<STRING>, landed_at INT"


def listings(spark, n=60):
    return spark.range(n).select(
        F.col("id").cast("string").alias("listing_key"), F.lit("Reno, NV").alias("location"), F.lit("u").alias("url"),
        F.when(F.col("id") % 3 == 0, "inline").when(F.col("id") % 3 == 1, "").alias("description"), F.lit("").alias("oracle_detail"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("k"), F.col("id") % 20)).alias("detail_api"),
    )


def details(spark):
    rows = [(f"k{n % 15}", f"text {n}", ["X", "Y"][: n % 3], n) for n in range(30)] + [(None, "lost", [], 1), ("k1", "old", ["Z"], -1)]
    return spark.createDataFrame(rows, DETAIL)


def test_a_store_gives_what_the_join_gives(spark, tmp_path):
    path, rows = str(tmp_path / "d"), listings(spark)
    write_details(details(spark).where("false"), path, 4)
    assert enrich.attach_stored_details(rows, open_details(spark, path, 4)).where("has_detail").count() == 20
    write_details(details(spark), path, 4)
    stored = enrich.attach_stored_details(rows, open_details(spark, path, 4))
    joined = enrich.attach_details(rows, enrich.latest_details(details(spark).where("detail_key IS NOT NULL")))
    assert sorted(map(repr, stored.select(joined.columns).collect())) == sorted(map(repr, joined.collect()))
    assert stored.where("description LIKE 'text %'").count() > 0 and stored.count() == 60


def test_the_store_does_not_move_and_rows_without_a_key_go_past(spark, tmp_path):
    path = str(tmp_path / "d")
    write_details(details(spark), path, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = enrich.attach_stored_details(listings(spark), open_details(spark, path, 4))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and re.search(r"Bucketed: true", plan)


def test_texts_as_files(spark, tmp_path):
    texts = ["one\ntwo", "", "ends\n", "\n\n", "windows\r\nline", "é漢", "x" * 100_000, None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(None, "lost")], "no INT, text STRING")
    folder = str(tmp_path / "files")
    write_whole_texts(rows, "no", "text", folder)
    got = {r["no"]: r["text"] for r in read_whole_texts(spark, folder, ends_with_break=True).collect()}
    assert got == {n: t or "" for n, t in enumerate(texts)}
    assert read_whole_texts(spark, folder, True).rdd.getNumPartitions() < len(texts)  # small files share a task


def tasks_started(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    return sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))


def test_texts_take_one_file_each_and_no_folder_is_looked_through(spark, tmp_path):
    folder = tmp_path / "files"
    rows = spark.range(0, 600, 1, 3).select((F.col("id") % 500).alias("no"), F.concat(F.lit("t"), "id").alias("text"))
    write_whole_texts(rows, "no", "text", str(folder))
    texts = [p for p in folder.rglob("*") if p.is_file() and LISTING not in p.parts]
    assert sorted(p.read_text() for p in texts) == sorted(f"t{n}\n" for n in range(600))  # repeated keys too
    assert len({p.parent for p in texts}) == 3
    assert tasks_started(spark, "open", lambda: read_whole_texts(spark, str(folder), True)) < 20
    got = read_whole_texts(spark, str(folder), True)
    assert got.columns == ["file_name", "text", "no"]
    assert sorted((r["no"], r["text"]) for r in got.collect()) == sorted((n % 500, f"t{n}") for n in range(600))


def test_tasks_that_read_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 400, 1, 2).select("id", F.repeat(F.lit("x"), 999).alias("text"))
    write_whole_texts(rows, "id", "text", str(tmp_path / "files"))
    monkeypatch.setattr("feedsift.sources.dimension.TASK_BYTES", 20_000)
    got = read_whole_texts(spark, str(tmp_path / "files"), True)
    assert got.rdd.getNumPartitions() == 20 and got.where("length(text) = 999").count() == 400


def test_files_that_are_not_listed_do_not_count_and_a_damaged_one_fails(spark, tmp_path):
    folder = tmp_path / "files"
    rows = spark.createDataFrame([("a/b", "x" * 9_000_000), ("é" * 90, "two"), ("..", None)], "name STRING, text STRING")
    write_whole_texts(rows.where("text = 'lost'"), "name", "text", str(folder))
    assert read_whole_texts(spark, str(folder)).count() == 0
    write_whole_texts(rows, "name", "text", str(folder))
    (folder / "dead-0").mkdir()
    (folder / "dead-0" / "a.0.txt").write_text("of a task that failed\n")
    got = {r["name"]: r["text"] for r in read_whole_texts(spark, str(folder), True).collect()}
    assert got == {"a/b": "x" * 9_000_000, "é" * 90: "two", "..": ""}
    next(p for p in folder.rglob("*.txt") if p.read_text() == "two\n").write_text("tw\n")
    with pytest.raises(PythonException, match="4 were written"):
        read_whole_texts(spark, str(folder)).collect()


def test_texts_on_a_file_system_that_is_not_mounted(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.texts.link./out", f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "one\ntwo"), (2, None), (None, "lost")], "no INT, text STRING")
    write_whole_texts(rows, "no", "text", "viewfs://texts/out/files")
    got = {r["no"]: r["text"] for r in read_whole_texts(spark, "viewfs://texts/out/files", True).collect()}
    assert got == {1: "one\ntwo", 2: ""} and not (tmp_path / "files" / LISTING).exists()
