import pytest

from pyspark.sql import functions as F

from feedsift.functions import predicates as p
from feedsift.rules import profiles
from feedsift.rules.profiles import RuleProfile
from feedsift.sources.dimension import load_profile


def check(apply, column, cases, kind="string"):
    got = apply(column, list(cases), kind)
    assert dict(zip(cases, got)) == cases


def test_title_include_is_a_substring_without_case(apply):
    check(apply, p.title_included, {
        "JUNIOR SOFTWARE ENGINEER": True, "Fullstack dev": True, "Analytics Engineers": True,
        "Carpenter": False, "Software": False, "": False,
    })
    assert apply(p.title_included, [None]) == [False]


def test_exclude_is_whole_word_with_ascii_boundaries(apply):
    check(apply, p.title_excluded, {
        "Lead Analyst": True, "Leadership Analyst": False, "misled": False, "Sr. Analyst": True,
        "analyst/head": True, "Head-count Analyst": True, "élead role": True, "lead_role": False,
        "overhead": False,
    })


def test_exemption_waives_only_the_seniority_terms(apply):
    check(apply, p.title_excluded, {
        "Senior Associate, Risk": False, "Sr. Associate": False, "sr associate": False,
        "Senior Associate Director": True, "Senior Analyst": True, "Senior": True,
        "Associate Senior": True,
    })


def test_an_empty_rule_list_excludes_nothing_and_includes_nothing(apply):
    nothing = RuleProfile((), (), (), ())
    assert apply(lambda x: p.title_excluded(x, nothing), ["Lead"]) == [False]
    assert apply(lambda x: p.title_included(x, nothing), ["Lead"]) == [False]
    assert apply(lambda x: p.location_blocked(x, ()), ["India"]) == [False]


def test_block_terms_are_substrings_of_any_place(apply):
    check(apply, p.location_blocked, {
        "Pune": True, "Remote, INDIA": True, "Indianapolis, Indiana": True,
        "Albuquerque, New Mexico": True, "Panama City, FL": True, "Portland, Oregon": False,
        "Leeds, UK": True, "São Paulo": True, "": False,
    })
    assert apply(p.location_blocked, [None]) == [False]


def test_region_test_reads_codes_in_capitals_only(apply):
    check(apply, p.looks_us, {
        "Boise, ID": True, "boise, id": False, "U.S.": True, "us": True, "u.s.a": True,
        "bus depot": False, "Remote": True, "remotely": False, "somewhere in texas": True,
        "WIDE": False, "VA - Reston": True, "Lisbon": False, "": False,
    })


def test_location_allow(apply):
    check(apply, p.location_allowed, {
        "": True, "   ": True, "3 Locations": True, "1 location": True, "12  LOCATIONS": True,
        "3 Locations total": False, "Oslo": False, "Tampa, FL": True,
    })
    assert apply(p.location_allowed, [None]) == [True]
    narrow = lambda x: p.location_allowed(x, ("Tampa", "remote"))
    check(apply, narrow, {"tampa bay": True, "Austin, TX": False, "REMOTE": True, "2 locations": True})


def test_priority_region_knows_namesakes(apply):
    check(apply, p.in_priority_region, {
        "Newark": True, "Newark, DE": True, "Newark, NJ": False, "Newark, New Jersey": False,
        "Wilmington, OH": False, "wilmington": True, "Pittsburgh, PA": True, "PHILADELPHIA": True,
        "Wilmington, DE · Trenton, NJ": True, "Newarkish": False, "Dover": False, "": False,
        "Newark, in town": False,
    })
    assert apply(p.in_priority_region, [None]) == [False]


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "title STRING, location STRING")


def picked(frame, condition):
    return {tuple(r) for r in frame.where(condition).collect()}


def test_match_profile_and_region_choice(spark):
    strict_only = ("Data Engineer", "Denver, CO")
    local_only = ("Senior Reporting Analyst", "Newark, DE")
    frame = rows(
        spark, strict_only, local_only, ("Senior Reporting Analyst", "Denver, CO"),
        ("VP, Analytics", "Newark, DE"), ("Data Engineer", "Remote, India"), (None, "Newark, DE"),
        ("Data Engineer", None),
    )
    assert picked(frame, p.matches_profile("title", "location")) == {
        strict_only, ("Data Engineer", None),
    }
    assert picked(frame, p.matches_by_region("title", "location")) == {
        strict_only, local_only, ("Data Engineer", None),
    }


def test_profiles_with_own_location_rules(spark):
    strict = RuleProfile(("dev",), (), ("denver",), ())
    local = RuleProfile(("dev",), (), (), ("newark",))
    frame = rows(spark, ("dev", "Denver"), ("dev", "Newark"), ("dev", "Dover, DE"), ("dev", "Reno"))
    assert picked(frame, p.matches_by_region("title", "location", strict, local)) == {
        ("dev", "Denver"), ("dev", "Dover, DE"),
    }


def test_recheck_lets_remote_skip_the_allow_test_only(spark):
    frame = spark.createDataFrame(
        [("Oslo", True), ("Oslo", False), ("Oslo", None), ("Pune", True), ("Reno, NV", None)],
        "location STRING, remote BOOLEAN",
    )
    kept = frame.where(p.location_still_ok("location", "remote")).collect()
    assert {tuple(r) for r in kept} == {("Oslo", True), ("Reno, NV", None)}


def test_age_filter_passes_the_unknown(apply):
    assert apply(lambda x: p.recent_enough(x, 7), [0, 7, 8, None], "BIGINT") == [
        True, True, False, True,
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This job is remote.", True), ("100% Remote", True), ("remote-eligible role", True),
        ("You may be working from home", True), ("We are open to fully remote people", True),
        ("Remote staff live anywhere in the US today", True),
        ("Remote staff live anywhere in the U.S. today", False), ("A remote-friendly office", False),
        ("remote control engineer", False), ("Remote. Apply within the US", False), ("", False),
    ],
)
def test_remote_wording(apply, text, expected):
    assert apply(p.mentions_remote, [text, None]) == [expected, False]


def test_profile_from_a_rule_table(spark):
    rules = spark.createDataFrame(
        [("a", "include", 2, "two"), ("a", "include", 1, "one"), ("a", "block", 1, "x"),
         ("b", "include", 1, "other")],
        "profile STRING, kind STRING, ord INT, term STRING",
    )
    assert load_profile(rules, "a") == RuleProfile(("one", "two"), (), (), ("x",))
    assert profiles.STRICT.block is profiles.LOCAL.block


def test_flag_filter_keeps_null(spark):
    frame = spark.createDataFrame([("no",), ("unknown",), (None,)], "flag_status STRING")
    assert frame.where(p.not_flagged("flag_status")).count() == 2
    assert frame.where(~p.not_flagged(F.col("flag_status"))).count() == 1
