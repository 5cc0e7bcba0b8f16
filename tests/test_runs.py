import json

import pytest
from pyspark.sql import functions as F

from feedsift.operators import enrich, matching, rank
from feedsift.operators.dedup import keep_last, lookup_first
from feedsift.operators.digest import digest, failure_notice, message_parts
from feedsift.operators.rollup import flag_breakdown, run_counters, source_counts, source_health
from feedsift.operators.tracker import tracker_rows
from feedsift.plans import queries
from feedsift.plans.run import RunOptions, preview, select_listings
from feedsift.rules.feeds import UNKNOWN, YES
from feedsift.sources import landed
from feedsift.sources.dimension import source_dimension
from feedsift.streaming import incremental
from feedsift.streaming.incremental import Tables, read_finished, run_pages, seen_table, start_incremental
from feedsift.streaming.seen import SeenTable
from feedsift.streaming.tables import Run, read_table, write_run

SCHEMA = (
    "seq BIGINT, company STRING, id STRING, title STRING, location STRING, url STRING, "
    "posted_on STRING, description STRING, cap_exempt BOOLEAN"
)
OPTIONS = RunOptions(as_of="2024-03-10")


def listings(spark, *rows):
    base = dict(company="C", title="Data Engineer", location="Reno, NV", url="u", posted_on="today",
                description=None, cap_exempt=False)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    full = [{**base, "seq": n, "id": str(n), **row} for n, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[k] for k in names) for r in full], SCHEMA)


def test_keep_last_sits_at_the_first_place(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None)], "k STRING, n INT, v STRING")
    got = keep_last(frame, ["k"], F.col("n")).orderBy("first_seq").collect()
    assert [tuple(r) for r in got] == [("a", 3, None, 1), ("b", 2, "y", 2)]


def test_dedup_keeps_the_last_matching_row_and_is_idempotent(spark):
    frame = listings(spark, {"id": "1"}, {"id": "1", "title": "Nurse"}, {"id": "2"}, {"id": "1", "title": "Nurse"})
    kept = matching.deduplicated(matching.matched(frame))
    assert {(r["listing_key"], r["seq"]) for r in kept.collect()} == {("C:1", 0), ("C:2", 2)}
    again = matching.deduplicated(kept.drop("listing_key", "first_seq"))
    assert again.select("seq").exceptAll(kept.select("seq")).count() == 0
    assert again.count() == kept.count()


def test_lookup_takes_the_first_row_per_name(spark):
    facts = spark.createDataFrame([("a",), ("b",), (None,)], "name STRING")
    names = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "name STRING, ord INT, v STRING")
    got = lookup_first(facts, names, "name", "ord", {"v": UNKNOWN}).collect()
    assert {tuple(r) for r in got} == {("a", "early"), ("b", UNKNOWN), (None, UNKNOWN)}


def ranked_ids(frame, **kwargs):
    frame = enrich.with_signals(matching.with_age(frame, OPTIONS.as_of))
    return [r["id"] for r in rank.ranked(rank.alertable(frame, **kwargs), "seq").collect()]


def test_each_sort_key_in_turn(spark):
    frame = listings(
        spark,
        {"id": "flagged", "description": "no sponsorship", "location": "Newark, DE"},
        {"id": "old", "posted_on": "9 days ago"},
        {"id": "unknown age", "posted_on": "?"},
        {"id": "tie 1"}, {"id": "tie 2"},
        {"id": "paid", "description": "$90,000", "posted_on": "9 days ago"},
        {"id": "paid more", "description": "$91k", "posted_on": "9 days ago"},
        {"id": "exempt", "cap_exempt": True, "posted_on": "9 days ago"},
        {"id": "near", "location": "Wilmington", "posted_on": "9 days ago"},
    )
    order = ["near", "exempt", "paid more", "paid", "tie 1", "tie 2", "old", "unknown age", "flagged"]
    assert ranked_ids(frame) == order
    assert ranked_ids(frame, skip_flagged=True) == order[:-1]
    assert ranked_ids(frame, max_days=3) == ["tie 1", "tie 2", "unknown age", "flagged"]


def test_top_counts_what_it_leaves_out(spark):
    frame = rank.alertable(enrich.with_signals(matching.with_age(listings(spark, *[{}] * 5), OPTIONS.as_of)))
    top = rank.top_listings(frame, 3, "seq").orderBy("rank_no").collect()
    assert [(r["seq"], r["rank_no"], r["extra"]) for r in top] == [(0, 1, 2), (1, 2, 2), (2, 3, 2)]
    assert {r["extra"] for r in rank.top_listings(frame, 9, "seq").collect()} == {0}


def top_of(spark, limit, *rows):
    frame = enrich.with_signals(matching.with_age(listings(spark, *rows), OPTIONS.as_of))
    return rank.top_listings(rank.alertable(frame), limit, "seq")


def test_digest_texts(spark):
    rows = [{"company": "A&B", "title": "x <y>", "description": "No sponsorship"}, {"url": "v"}]
    got = digest(top_of(spark, 5, *rows)).first()
    assert got["text_message"] == (
        "🔔 2 new role(s) — 1 sponsorable, 1 flagged:\n\n"
        "<b>C</b>: Data Engineer\n  Reno, NV\n  today\n  v\n\n"
        "⛔ <b>A&amp;B</b>: x &lt;y&gt;\n  Reno, NV\n  today · ⛔ no sponsorship — no sponsorship\n  u"
    )
    assert got["html_message"] == (
        "<p>2 new role(s) matched — 1 sponsorable, 1 flagged:</p><ul>"
        '<li><strong>C</strong> — <a href="v">Data Engineer</a><br><small>Reno, NV · today</small></li>'
        '<li>⛔ <strong>A&amp;B</strong> — <a href="u">x &lt;y&gt;</a><br>'
        "<small>Reno, NV · today · ⛔ no sponsorship — no sponsorship</small></li></ul>"
    )


def test_digest_tail_parts_and_empty_list(spark):
    top = top_of(spark, 2, *[{}] * 5)
    got = digest(top).first()
    assert got["text_message"].startswith("🔔 5 new role(s) — 2 sponsorable, 0 flagged:")
    assert got["text_message"].endswith("\n\n…and 3 more — see the tracker.")
    assert got["html_message"].endswith("<p>…and 3 more — see the tracker.</p>")
    parts = [r["part"] for r in message_parts(digest(top), 60).orderBy("part_no").collect()]
    assert len(parts) > 1 and all(len(p) <= 60 for p in parts)
    assert "\n\n".join(parts) == got["text_message"]
    assert digest(top.where("false")).count() == 0


def test_details_by_precedence(spark):
    rows = [
        {"description": "inline", "url": "https://a.myworkdayjobs.com/1"},
        {"description": "", "url": "https://a.myworkdayjobs.com/1"},
        {"url": "https://a.myworkdayjobs.com/none"}, {}, {}, {},
    ]
    frame = listings(spark, *rows).withColumns({
        "listing_key": F.col("id"),
        "oracle_detail": F.when(F.col("seq") == 3, "orc").otherwise(""),
        "detail_api": F.when(F.col("seq") == 4, "api"),
    })
    details = spark.createDataFrame(
        [("https://a.myworkdayjobs.com/1", "w", ["X", "Y"]), ("orc", "o", []), ("api", "", ["Z"])],
        "detail_key STRING, description STRING, locations ARRAY<STRING>",
    )
    got = enrich.attach_details(frame, details).orderBy("seq").collect()
    assert [(r["description"], r["location"], r["has_detail"]) for r in got] == [
        ("inline", "Reno, NV", True), ("w", "X · Y", True), (None, "Reno, NV", False),
        ("o", "Reno, NV", True), ("", "Z", True), (None, "Reno, NV", False),
    ]
    signals = enrich.with_signals(enrich.attach_details(frame, details)).orderBy("seq").collect()
    assert [(r["flag_status"], r["remote"]) for r in signals][2:5] == [
        ("unknown", None), ("unknown", False), ("unknown", False),
    ]


def test_latest_detail_wins(spark):
    frame = spark.createDataFrame(
        [("k", 1, "old", ["a"]), ("k", 2, "new", ["b"])],
        "detail_key STRING, n INT, description STRING, locations ARRAY<STRING>",
    )
    assert enrich.latest_details(frame, "n").first()["description"] == "new"


def test_select_rechecks_the_resolved_place(spark):
    frame = listings(
        spark,
        {"location": "2 Locations", "url": "https://a.myworkdayjobs.com/0"},
        {"location": "2 Locations", "url": "https://a.myworkdayjobs.com/1"},
        {"location": "2 Locations", "url": "https://a.myworkdayjobs.com/2"},
        {"posted_on": "15 days ago"},
    ).withColumns({"oracle_detail": F.lit(""), "detail_api": F.lit("")})
    details = spark.createDataFrame(
        [("https://a.myworkdayjobs.com/0", "x", ["Oslo"]), ("https://a.myworkdayjobs.com/1", "fully remote", ["Oslo"]),
         ("https://a.myworkdayjobs.com/2", "fully remote", ["Pune"])],
        "detail_key STRING, description STRING, locations ARRAY<STRING>",
    ).withColumn("landed_at", F.lit(1))
    assert [r["id"] for r in select_listings(frame, OPTIONS, details).collect()] == ["1"]
    assert preview(frame, OPTIONS).count() == 3


def test_counters(spark):
    frame = spark.createDataFrame(
        [("no", True), ("unknown", True), ("unknown", False), (None, True)], "flag_status STRING, is_fresh BOOLEAN"
    )
    failures = spark.createDataFrame([(True,), (False,)], "source_failed BOOLEAN")
    got = run_counters(spark.range(9), frame, failures, skip_flagged=True, max_shown=1).first().asDict()
    assert got == {"fetched": 9, "matched": 4, "flagged": 1, "fresh": 3, "alertable": 2, "failed": 1, "shown": 1}
    assert tuple(flag_breakdown(frame).first()) == (3, 1)
    none = run_counters(spark.range(0), frame.where("false"), failures.where("false")).first()
    assert set(none.asDict().values()) == {0}
    per_source = spark.createDataFrame([(1,), (1,), (2,)], "source_ord INT")
    assert {tuple(r) for r in source_counts(per_source).collect()} == {(1, 2), (2, 1)}


def test_tracker(spark):
    sources = (("Known", "lever", ("k",), YES, YES, False), ("Known", "lever", ("l",), UNKNOWN, "No", False))
    frame = enrich.with_signals(listings(
        spark, {"company": "Known", "description": "Pay $80k"},
        {"company": "Known", "description": "no sponsorship", "location": ""}, {"company": "New", "posted_on": ""}))
    got = tracker_rows(frame, source_dimension(spark, sources), "me", "2024-03-10", 2).orderBy("notes").collect()
    assert [(r["company"], r["everify"], r["sponsors"], r["notes"]) for r in got] == [
        ("New", UNKNOWN, UNKNOWN, "Auto-added by monitor 2024-03-10 · Reno, NV"),
        ("Known", YES, YES, "Auto-added by monitor 2024-03-10 · Reno, NV · today · Salary $80k"),
        ("Known", YES, "No", "Auto-added by monitor 2024-03-10 · today · ⚠ no sponsorship"),
    ]
    assert got[0].asDict().keys() == {
        "user_id", "company", "role", "location", "status", "link", "everify", "sponsors", "notes"}


SOURCE = (("Board", "greenhouse", ("b",), YES, YES, False),)


def poll(spark, run_id, *ids):
    jobs = [{"id": i, "title": "Data Engineer", "location": {"name": "Reno, NV"}, "absolute_url": f"u{i}"} for i in ids]
    return spark.createDataFrame(
        [(run_id, 0, 0, 0, json.dumps({"jobs": jobs}), False)], landed.LANDED_SCHEMA)


def contents(spark, tables):
    seen = {(r["listing_key"], r["run_id"]) for r in seen_table(spark, tables).rows().collect()}
    links = sorted(r["link"] for r in read_finished(spark, tables, tables.tracker).collect())
    messages = {r["run_id"]: r["part"] for r in read_finished(spark, tables, tables.messages).collect()}
    return seen, links, messages


def test_stream_equals_batch_and_a_repeated_run_changes_nothing(spark, tmp_path):
    batch, stream = Tables(str(tmp_path / "batch")), Tables(str(tmp_path / "stream"))
    polls = [poll(spark, 0, 1, 2), poll(spark, 1, 2, 3), poll(spark, 2, 1, 3)]
    for n, pages in enumerate(polls):
        run_pages(pages, batch, n, OPTIONS, sources=SOURCE)
        pages.write.mode("append").json(str(tmp_path / "landed"))
        start_incremental(
            spark, str(tmp_path / "landed"), stream, str(tmp_path / "state"), OPTIONS, sources=SOURCE
        ).awaitTermination()
    first = contents(spark, batch)
    assert first == contents(spark, stream)
    assert first[0] == {("Board:1", 0), ("Board:2", 0), ("Board:3", 1)}
    assert first[1] == ["u1", "u2", "u3"]
    assert set(first[2]) == {0, 1} and first[2][1].startswith("🔔 1 new role(s)")
    run_pages(polls[1], batch, 1, OPTIONS, sources=SOURCE)
    assert contents(spark, batch) == first


def test_a_new_checkpoint_keeps_recorded_keys_and_alerts_none_twice(spark, tmp_path):
    tables = Tables(str(tmp_path / "tables"))
    for n, ids in enumerate(([1, 2], [2, 3])):
        poll(spark, n, *ids).write.json(str(tmp_path / f"landed-{n}"))
        start_incremental(
            spark, str(tmp_path / f"landed-{n}"), tables, str(tmp_path / f"state-{n}"), OPTIONS, sources=SOURCE
        ).awaitTermination()
    seen, links, _ = contents(spark, tables)
    assert {k for k, _ in seen} == {"Board:1", "Board:2", "Board:3"}
    assert links == ["u1", "u2", "u3"]


def test_a_repeated_run_without_rows_empties_its_partition(spark, tmp_path):
    run, path = Run("j", 4), str(tmp_path)
    frame = spark.createDataFrame([("k",)], "listing_key STRING")
    write_run(frame, path, Run("j", 3))
    write_run(frame, path, run)
    write_run(frame.where("false"), path, run)
    assert [r["run_id"] for r in read_table(spark, path, "listing_key STRING, job STRING, run_id BIGINT").collect()] == [3]


def test_first_place_survives_both_merges(spark):
    def page(term, *ids):
        jobs = [{"title": "Data Engineer", "externalPath": f"/job/{i}", "locationsText": "Reno, NV", "bulletFields": [i]} for i in ids]
        return (0, 0, term, 0, json.dumps({"total": len(ids), "jobPostings": jobs}), False)

    pages = spark.createDataFrame([page(0, "A", "B"), page(1, "A")], landed.LANDED_SCHEMA)
    sources = (("Firm", "workday", ("f", "wd1", "s"), YES, YES, False),)
    found = preview(landed.collect_listings(pages, source_dimension(spark, sources)), OPTIONS)
    assert [r["id"] for r in found.collect()] == ["A", "B"]


def test_a_detail_that_landed_twice_counts_once(spark):
    frame = listings(spark, {"url": "https://a.myworkdayjobs.com/0"}).withColumns(
        {"oracle_detail": F.lit(""), "detail_api": F.lit("")}
    )
    details = spark.createDataFrame(
        [("https://a.myworkdayjobs.com/0", "old", [], 1), ("https://a.myworkdayjobs.com/0", "new", [], 2)],
        "detail_key STRING, description STRING, locations ARRAY<STRING>, landed_at INT",
    )
    assert [r["description"] for r in select_listings(frame, OPTIONS, details).collect()] == ["new"]


def test_unknown_sources_and_broken_lines_are_reported(spark, tmp_path):
    lines = [json.dumps({"run_id": 7, "source_ord": 9, "term_no": 0, "page_offset": 0, "payload": "{}", "failed": False}), "{broken"]
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.json").write_text("\n".join(lines))
    dimension = source_dimension(spark, SOURCE)
    pages = landed.read_landed(spark, str(tmp_path / "landed"))
    landed.land_pages(pages, dimension, str(tmp_path / "stored"))
    status = landed.source_status(landed.term_status(landed.read_stored(spark, str(tmp_path / "stored"))))
    assert {(r["run_id"], r["source_ord"], r["source_failed"]) for r in status.collect()} == {(7, 9, True), (None, None, True)}
    notices = failure_notice(status, dimension, 1).collect()
    assert {r["notice"].rpartition(": ")[2] for r in notices} == {"unknown source"}
    counts = landed.parse_pages(landed.with_source(pages, dimension, "ats", "address"))
    health = source_health(counts, dimension, 1).where("run_id = 7").collect()
    assert {(r["company"], r["status"], r["n_bad"]) for r in health} == {("Board", "not checked", 1), ("unknown source", "bad", 1)}


def test_caps_are_a_choice(spark):
    rows = [(0, 0, 0, 20 * n, 20, 400.0, False, "workday") for n in range(15)]
    pages = spark.createDataFrame(
        rows, "run_id BIGINT, source_ord INT, term_no INT, page_offset INT, n_rows BIGINT, total DOUBLE, failed BOOLEAN, ats STRING"
    )
    caps = {"workday": 200}
    assert landed.bounded_pull(pages, landed.term_status(pages)).count() == 15
    assert landed.bounded_pull(pages, landed.term_status(pages, caps), caps).count() == 10
    assert landed.pages_left_out(pages, caps).first()[0] == 5 and landed.pages_left_out(pages).first()[0] == 0


def test_a_run_emits_all_it_has_to_say(spark, tmp_path):
    tables = Tables(str(tmp_path))
    sources = (*SOURCE, *[(f"F{n}", "lever", ("x",), YES, YES, False) for n in range(3)])
    broken = spark.createDataFrame([(0, n, 0, 0, "{", False) for n in (1, 2, 3)], landed.LANDED_SCHEMA)
    run_pages(poll(spark, 0, 1, 2).union(broken), tables, 0, OPTIONS, sources=sources)
    mail = spark.read.parquet(tables.emails).first()
    assert mail["subject"] == "2 new job match(es)" and mail["html"].startswith("<p>2 new role(s)")
    assert spark.read.parquet(tables.notices).first()["notice"].endswith("F0, F1, F2")
    counters = spark.read.parquet(tables.counters).drop("job", "run_id").first().asDict()
    assert counters == {
        "fetched": 2, "matched": 2, "flagged": 0, "fresh": 2, "alertable": 2, "failed": 3, "shown": 2, "pages_left_out": 0,
    }


def test_seed_records_and_stays_silent(spark, tmp_path):
    tables = Tables(str(tmp_path))
    run_pages(poll(spark, 0, 1, 2), tables, 0, RunOptions(as_of="2024-03-10", seed=True), sources=SOURCE)
    assert seen_table(spark, tables).rows().count() == 2
    assert not (tmp_path / "tracker").exists() and not (tmp_path / "messages").exists()


def test_a_folder_is_needed_off_the_local_machine(spark, monkeypatch):
    from feedsift import session

    assert session.shared_folder(spark, "x").startswith(spark.conf.get(session.CHECKPOINT_KEY))

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        session.shared_folder(Cluster, "x")


def test_incremental_queries_run_the_job_on_each_call(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(queries, "N_POLLS", 1)
    monkeypatch.setattr(queries.views, "landed_pages", lambda s, d: s.createDataFrame([], "run_id BIGINT, payload STRING"))
    monkeypatch.setattr(queries.views, "feed_details", lambda s, d: None)
    monkeypatch.setattr(queries, "flatten_details", lambda d: None)

    class Job:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(queries, "start_incremental", lambda s, landed, *rest: jobs.append(landed) or Job())
    for _ in range(2):
        queries.incremental_run(spark, "same folder")
    assert len(set(jobs)) == 2


def test_polls_read_stored_details(spark, monkeypatch):
    """Details are built and parsed once, not by every poll."""
    plans = []

    class Started:
        def awaitTermination(self):
            pass

    def started(spark, path, tables, checkpoint, options, details):
        plans.append(details._jdf.queryExecution().optimizedPlan().toString())
        return Started()

    monkeypatch.setattr(queries, "start_incremental", started)
    queries._incremental(spark, "/root/testdata/sf0.001")
    assert len(plans) == queries.N_POLLS
    assert not any(word in plan for plan in plans for word in ("from_json", "jsontostructs", "o_orderkey"))
