import json

from pyspark.sql import functions as F

from feedsift.operators.digest import failure_notice
from feedsift.operators.rollup import source_health
from feedsift.rules.feeds import OFFSET_CAPS, SOURCES, UNKNOWN, YES
from feedsift.sources import landed
from feedsift.sources.details import flatten_details
from feedsift.sources.dimension import read_whole_texts, source_dimension
from feedsift.sources.payloads import explode_pages, parse_pages

FIRM = ("Firm", "workday", ("firm", "wd1", "site"), YES, YES, True)
BOARD = ("Board", "greenhouse", ("brd",), YES, UNKNOWN, False)
PLAIN = ("Plain", "lever", ("pln",), UNKNOWN, YES, False)
BANK = ("Bank", "oracle", ("bank.example.com", "S1"), YES, YES, False)
OTHER = ("Other", "icims", ("other.example.com",), YES, YES, False)
ALL = (FIRM, BOARD, PLAIN, BANK, OTHER)


def pages(spark, *rows):
    """rows: (source_ord, term_no, page_offset, payload or None)"""
    full = [
        (0, s, t, o, p if p is None or isinstance(p, str) else json.dumps(p), p is None)
        for s, t, o, p in rows
    ]
    return spark.createDataFrame(full, landed.LANDED_SCHEMA)


def normalised(spark, sources, *rows):
    frame = landed.with_source(
        pages(spark, *rows), source_dimension(spark, sources), "company", "ats", "address"
    )
    keep = ("source_ord", "term_no", "page_offset", "company")
    return [r.asDict() for r in explode_pages(frame, *keep).orderBy("page_offset", "pos").collect()]


def test_workday_ids_and_defaults(spark):
    got = normalised(spark, [FIRM], (0, 0, 0, {"total": 4, "jobPostings": [
        {"title": "A", "externalPath": "/job/a", "locationsText": "L", "postedOn": "P", "bulletFields": ["R1", "x"]},
        {"title": "B", "externalPath": "/job/b", "bulletFields": [""]},
        {"title": "C", "externalPath": "/job/c", "bulletFields": []},
        {"externalPath": "/job/d"},
    ]}))
    assert [g["id"] for g in got] == ["R1", "/job/b", "/job/c", "/job/d"]
    assert got[0]["url"] == "https://firm.wd1.myworkdayjobs.com/site/job/a"
    assert (got[0]["location"], got[0]["posted_on"]) == ("L", "P")
    assert (got[3]["title"], got[3]["location"], got[3]["posted_on"]) == (None, "", "")


def test_greenhouse(spark):
    got = normalised(spark, [BOARD], (0, 0, 0, {"jobs": [
        {"id": 9007199254740993, "title": "A", "location": {"name": "L"}, "absolute_url": "u", "updated_at": "2024-05-06T07:08:09Z"},
        {"id": 2},
    ]}))
    assert got[0]["id"] == "9007199254740993"
    assert got[0]["posted_on"] == "2024-05-06"
    assert got[0]["detail_api"] == "https://boards-api.greenhouse.io/v1/boards/brd/jobs/9007199254740993"
    assert (got[1]["title"], got[1]["location"], got[1]["posted_on"], got[1]["url"]) == ("", "", "", None)


def test_lever_day_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        got = normalised(spark, [PLAIN], (0, 0, 0, [
            {"id": "1", "text": "A", "categories": {"location": "L"}, "hostedUrl": "u", "createdAt": 1704067199999, "descriptionPlain": "d"},
            {"id": "2", "createdAt": 0}, {"id": "3", "createdAt": -1},
        ]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [g["posted_on"] for g in got] == ["2023-12-31", "", "1969-12-31"]
    assert (got[0]["description"], got[1]["description"], got[1]["title"]) == ("d", "", "")


def test_oracle_reads_the_first_item_only(spark):
    got = normalised(spark, [BANK], (0, 0, 0, {"items": [
        {"requisitionList": [
            {"Id": "7", "Title": "A", "PrimaryLocation": "X", "ExternalPostedStartDate": "", "PostedDate": "2024-01-01",
             "secondaryLocations": [{"Name": ""}, {"Name": "Y"}, {}]},
            {"Id": "8", "PostedDate": "2024-01-02T00:00"},
        ]},
        {"requisitionList": [{"Id": "9"}]},
    ]}))
    assert [g["id"] for g in got] == ["7", "8"]
    assert (got[0]["location"], got[0]["posted_on"]) == ("X · Y", "")
    assert (got[1]["location"], got[1]["posted_on"], got[1]["title"]) == ("", "2024-01-02", "")
    assert got[0]["oracle_detail"].endswith("Id=%227%22,siteNumber=S1")
    assert got[0]["url"] == "https://bank.example.com/hcmUI/CandidateExperience/en/sites/S1/job/7"


def test_missing_lists_and_bad_payloads(spark):
    rows = [(0, 0, 0, {}), (0, 0, 20, "{bad"), (1, 0, 0, {"jobs": None}), (1, 0, 1, None),
            (2, 0, 0, []), (2, 0, 1, "null"), (2, 0, 2, "[1"), (3, 0, 0, {"items": []}), (4, 0, 0, "<html>")]
    frame = landed.with_source(pages(spark, *rows), source_dimension(spark, ALL), "ats", "address")
    counted = parse_pages(frame).orderBy("source_ord", "page_offset").collect()
    assert [r["failed"] for r in counted] == [False, True, False, True, False, False, True, False, False]
    assert {r["n_rows"] for r in counted} == {0}
    assert explode_pages(frame, "source_ord").count() == 0


def page_of(total, *ids):
    return {"total": total, "jobPostings": [
        {"title": f"T{i}", "externalPath": f"/{i}", "bulletFields": [str(i)]} for i in ids
    ]}


def pulled(spark, *rows):
    frame = landed.with_source(pages(spark, *rows), source_dimension(spark, ALL), "ats", "address")
    status = landed.term_status(parse_pages(frame), OFFSET_CAPS)
    got = landed.bounded_pull(frame, status, OFFSET_CAPS).orderBy("term_no", "page_offset").collect()
    return [(r["term_no"], r["page_offset"]) for r in got], {
        r["term_key"]: r["term_failed"] for r in status.collect()
    }


def test_pull_stops_at_total_empty_page_missing_total_and_cap(spark):
    many = [(0, 3, o, page_of(9999, o)) for o in range(0, 400, 20)]
    kept, failed = pulled(
        spark,
        (0, 0, 0, page_of(30, 1)), (0, 0, 20, page_of(30, 2)), (0, 0, 40, page_of(30, 3)),
        (0, 1, 0, page_of(90, 1)), (0, 1, 20, page_of(90)), (0, 1, 40, page_of(90, 2)),
        (0, 2, 0, page_of(None, 1)), (0, 2, 20, page_of(90, 2)),
        *many,
    )
    assert kept == [(0, 0), (0, 20), (1, 0), (1, 20), (2, 0)] + [(3, o) for o in range(0, 200, 20)]
    assert not any(failed.values())


def test_a_failure_counts_only_when_it_is_reached(spark):
    kept, failed = pulled(
        spark,
        (0, 0, 0, page_of(90, 1)), (0, 0, 20, None), (0, 0, 40, page_of(90, 3)),
        (0, 1, 0, page_of(20, 1)), (0, 1, 20, None),
    )
    assert kept == [(0, 0), (0, 20), (1, 0)]
    assert failed == {0: True, 1: False}


def test_collect_merges_terms_by_id_and_leaves_boards_alone(spark):
    rows = [
        (0, 0, 0, page_of(20, 1, 2)), (0, 1, 0, page_of(20, 2, 3)), (0, 2, 0, None),
        (1, 0, 0, {"jobs": [{"id": 1, "title": "a"}, {"id": 1, "title": "b"}]}),
        (3, 0, 0, None),
        (4, 0, 0, "<html>"),
    ]
    got = landed.collect_listings(pages(spark, *rows), source_dimension(spark, ALL)).orderBy("first_seq", "seq").collect()
    assert [(r["company"], r["id"], r["seq"]["term_no"], r["first_seq"]["term_no"]) for r in got] == [
        ("Firm", "1", 0, 0), ("Firm", "2", 1, 0), ("Firm", "3", 1, 1), ("Board", "1", 0, 0), ("Board", "1", 0, 0),
    ]
    assert {r["company"]: r["cap_exempt"] for r in got} == {"Firm": True, "Board": False}


def test_stored_pages_give_the_same_listings(spark, tmp_path):
    dimension = source_dimension(spark, ALL)
    raw = pages(
        spark, (0, 0, 0, page_of(40, 1, 2)), (0, 0, 20, "{bad"), (0, 1, 0, page_of(20, 2)),
        (1, 0, 0, {"jobs": [{"id": 5}]}), (2, 0, 0, [{"id": "x"}]), (4, 0, 0, "<html>"),
    )
    landed.land_pages(raw, dimension, str(tmp_path / "p"))
    stored = landed.collect_listings(landed.read_stored(spark, str(tmp_path / "p")), dimension)
    direct = landed.collect_listings(raw, dimension)
    assert sorted(stored.collect(), key=str) == sorted(direct.select(stored.columns).collect(), key=str)
    assert stored.count() == 3


def test_failed_sources_and_notice(spark):
    dimension = source_dimension(spark, ALL)
    frame = landed.with_source(
        pages(spark, (0, 0, 0, None), (0, 1, 0, page_of(1, 1)), (1, 0, 0, None), (2, 0, 0, "x"), (3, 0, 0, None)),
        dimension, "ats", "address",
    )
    state = landed.source_status(landed.term_status(parse_pages(frame)))
    assert {r["source_ord"]: r["source_failed"] for r in state.collect()} == {0: False, 1: True, 2: True, 3: True}
    notice = failure_notice(state, dimension).first()
    assert notice["notice"] == "⚠️ 3 sources failed to fetch this run: Board, Plain, Bank"
    assert failure_notice(state, dimension, 4).count() == 0


def test_health_lists_every_source(spark):
    dimension = source_dimension(spark, (FIRM, FIRM, BOARD))
    counted = parse_pages(landed.with_source(
        pages(spark, (0, 0, 0, page_of(7, 1)), (0, 1, 0, None), (2, 0, 0, {"jobs": []})), dimension, "ats", "address"))
    health = source_health(counted, dimension, 3)
    assert {(r["source_ord"], r["status"], r["total"]) for r in health.collect()} == {
        (0, "ok", 7.0), (1, "bad", None), (2, "not checked", None),
    }
    assert {(r["run_id"], r["n_bad"], r["all_healthy"]) for r in health.collect()} == {(0, 1, False)}


def test_details(spark):
    rows = [
        ("w", "workday", {"jobPostingInfo": {"jobDescription": "<b>x</b>&lt;i&gt;", "location": "A", "additionalLocations": ["", "B"]}}),
        ("g", "greenhouse", {"content": "&lt;b&gt;x&amp;amp;y&lt;/b&gt;", "location": {"name": ""}}),
        ("o", "oracle", {"items": [{"ExternalDescriptionStr": "<p>a</p>", "ExternalResponsibilitiesStr": "c", "PrimaryLocation": "P", "secondaryLocations": [{"Name": "S"}]}]}),
        ("e", "workday", {}),
    ]
    frame = spark.createDataFrame(
        [(k, a, json.dumps(p)) for k, a, p in rows] + [("bad", "oracle", "{"), ("none", "workday", None)],
        "detail_key STRING, ats STRING, payload STRING",
    )
    got = {r["detail_key"]: (r["description"], r["locations"]) for r in flatten_details(frame).collect()}
    assert got == {
        "w": ("x &lt;i&gt;", ["A", "B"]), "g": ("x&amp;y", []), "o": ("a c", ["P", "S"]), "e": ("", []),
    }


def test_default_source_list(spark):
    counts = source_dimension(spark).groupBy("ats").count().collect()
    assert {r["ats"]: r["count"] for r in counts} == {
        "workday": 22, "greenhouse": 30, "lever": 1, "oracle": 2, "icims": 1,
    }
    assert len({name for name, *_ in SOURCES}) == 55
    assert landed.search_terms(spark).count() == 4


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    got = read_whole_texts(spark, str(tmp_path)).select("file_name", F.length("text")).collect()
    assert [tuple(r) for r in got] == [("a.txt", 8)]
