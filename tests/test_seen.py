"""The seen table, runs that die half-way, and what a run leaves behind."""

import pytest
from pyspark.sql import functions as F
from test_runs import OPTIONS, SOURCE, contents, poll

from feedsift.plans.run import RunOptions
from feedsift.streaming import incremental
from feedsift.streaming.incremental import Tables, read_finished, run_pages, seen_table
from feedsift.streaming.seen import SeenTable
from feedsift.streaming.tables import Run, finish, finished, read_table, withdraw, write_run


def keys(spark, ids):
    return spark.createDataFrame([(str(i),) for i in ids], "listing_key STRING")


def step(table, number, ids):
    run = Run("j", number)
    table.begin(run)
    rows = keys(table.spark, ids)
    fresh = table.unseen(rows, run)
    found = sorted(int(r[0]) for r in fresh.collect())
    table.record(fresh, run)
    return found


def test_files_read_do_not_grow_with_runs(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path), "listing_key STRING", buckets=4, fold_after=3)
    read, scans = [], 50
    for n in range(scans):
        run, ids = Run("j", n), range(20 * n, 20 * n + 40)  # half of them new
        table.begin(run)
        table.record(table.unseen(keys(spark, ids), run), run)
        read.append(len(table.rows(list(range(4))).inputFiles()))
    assert max(read[5:]) <= max(read[:5]) <= 4 * 3
    rows = table.rows().collect()
    assert sorted(int(r["listing_key"]) for r in rows) == list(range(20 * scans + 20))
    assert {int(r["listing_key"]): r["run_id"] for r in rows}[25 * 20 + 30] == 25


def test_only_buckets_that_are_hit_are_read(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path), "listing_key STRING", buckets=16)
    step(table, 0, range(500))
    hit = [r[0] for r in keys(spark, [7]).select(table.bucket()).collect()]
    assert len(table.rows().inputFiles()) == 16
    assert table.rows(hit).select(F.input_file_name()).distinct().count() == 1
    plan = table.unseen(keys(spark, [7]), Run("j", 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_repeated_runs_find_their_own_keys_also_when_folded(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path), "listing_key STRING", buckets=2, fold_after=2)
    for n in range(5):
        assert step(table, n, range(n, n + 5)) == (list(range(5)) if n == 0 else [n + 4])
    whole = sorted((r["listing_key"], r["run_id"]) for r in table.rows().collect())
    for n in (4, 1):
        assert step(table, n, range(n, n + 5)) == (list(range(5)) if n == 0 else [n + 4])
        assert sorted((r["listing_key"], r["run_id"]) for r in table.rows().collect()) == whole
    assert step(table, 1, []) == [] and "5" not in {r["listing_key"] for r in table.rows().collect()}


def test_a_fold_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    table = SeenTable(spark, str(tmp_path), "listing_key STRING", buckets=2, fold_after=2)
    for n in range(3):
        step(table, n, range(3 * n, 3 * n + 3))
    asked, folded = [], SeenTable.folded

    def lost(self, gen):
        asked.append(gen)
        if len(asked) > 1:  # first to see what is folded, then to write the list of the new base
            raise RuntimeError("lost")
        return folded(self, gen)

    monkeypatch.setattr(SeenTable, "folded", lost)
    with pytest.raises(RuntimeError):
        table.begin(Run("j", 3))
    monkeypatch.undo()
    assert len(list((tmp_path / "base").iterdir())) == len(list((tmp_path / "folded").iterdir())) + 1
    assert table.rows().count() == 9
    assert step(table, 3, range(8, 11)) == [9, 10]
    assert table.rows().count() == 11


def test_null_keys_and_empty_runs(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path), "listing_key STRING", fold_after=1)
    rows = spark.createDataFrame([(None,), ("a",)], "listing_key STRING")
    for n in range(3):
        run = Run("j", n)
        table.begin(run)
        fresh = table.unseen(rows, run)
        table.record(fresh, run)
    assert [r["listing_key"] for r in table.rows().collect()].count("a") == 1
    assert step(SeenTable(spark, str(tmp_path / "none"), "listing_key STRING"), 0, []) == []


def test_rows_of_unfinished_runs_do_not_show(spark, tmp_path):
    path, runs = str(tmp_path / "t"), str(tmp_path / "runs")
    for n in range(2):
        write_run(keys(spark, [n]), path, Run("j", n))
    table = read_table(spark, path, "listing_key STRING, job STRING, run_id BIGINT")
    assert finished(table, runs).count() == 0
    finish(spark, runs, Run("j", 1))
    assert [r["run_id"] for r in finished(table, runs).collect()] == [1]
    withdraw(spark, runs, Run("j", 1))
    assert finished(table, runs).count() == 0


WRITES = ("message_parts", "finish")


@pytest.mark.parametrize("broken", WRITES)
def test_a_run_that_dies_between_writes_shows_nothing_and_shows_once_when_repeated(spark, tmp_path, monkeypatch, broken):
    tables, whole = Tables(str(tmp_path / "a")), Tables(str(tmp_path / "b"))
    polls = [poll(spark, 0, 1, 2), poll(spark, 1, 2, 3)]
    for n, pages in enumerate(polls):
        run_pages(pages, whole, n, OPTIONS, sources=SOURCE)
    run_pages(polls[0], tables, 0, OPTIONS, sources=SOURCE)
    before = contents(spark, tables)

    def lost(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, broken, lost)
    with pytest.raises(RuntimeError):
        run_pages(polls[1], tables, 1, OPTIONS, sources=SOURCE)
    monkeypatch.undo()
    assert contents(spark, tables) == before
    run_pages(polls[1], tables, 1, OPTIONS, sources=SOURCE)
    assert contents(spark, tables) == contents(spark, whole)
    assert read_finished(spark, tables, tables.counters).count() == 2


def test_a_key_of_a_run_that_never_finished_is_still_new(spark, tmp_path, monkeypatch):
    tables = Tables(str(tmp_path))
    monkeypatch.setattr(incremental, "emit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run_pages(poll(spark, 0, 1), tables, 0, OPTIONS, sources=SOURCE)
    monkeypatch.undo()
    run_pages(poll(spark, 1, 1, 2), tables, 1, OPTIONS, sources=SOURCE)
    assert {(r["listing_key"], r["run_id"]) for r in seen_table(spark, tables).rows().collect()} == {("Board:1", 1), ("Board:2", 1)}


@pytest.mark.parametrize("seed", [False, True])
def test_a_run_leaves_nothing_stored_for_itself(spark, tmp_path, seed):
    tables = Tables(str(tmp_path))
    run_pages(poll(spark, 0, 1), tables, 0, RunOptions(as_of="2024-03-10", seed=seed), sources=SOURCE)
    assert not list((tmp_path / "scratch").glob("*/*/*"))
    assert seen_table(spark, tables).rows().select(F.count("*")).first()[0] == 1
