"""Rule tables of any length against the patterns of short profiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from feedsift.functions import predicates
from feedsift.operators import rank, rule_table
from feedsift.operators.ordinal import numbered
from feedsift.rules import profiles
from feedsift.rules.profiles import RuleProfile

LISTING = "seq BIGINT, title STRING, location STRING"
TITLES = (
    "Software Engineer", "Senior Software Engineer", "Senior Associate, Data Analyst", "Sr. Associate data analyst", None, "",
    "Head of Data", "Headof data engineer", "headhunter data engineer", "DATA ENGINEER (VP)", "metadata engineering", "C++ / C# developer",
    "x" * 5000 + " data engineer", "a", "sr", "R&D \\E lead [x]", "data  engineer", "full stack", "_vp_ data engineer", "vp- data engineer",
)
PLACES = ("Austin, TX", "Pune", None, "", "2 Locations", "Hyderabad, India", "Remote", "Toronto, ON", "london, uk", "Dover, DE", "Oslo")


def table(spark, **named):
    return spark.createDataFrame(
        [row for name, profile in named.items() for row in rule_table.profile_rows(name, profile)], rule_table.RULE_SCHEMA
    )


def listings(spark):
    rng = random.Random(1)
    rows = [(n, rng.choice(TITLES), rng.choice(PLACES)) for n in range(600)]
    return spark.createDataFrame(rows, LISTING).repartition(4)


ODD = RuleProfile(("a", "c#", "++", "\\E", "engineer", "", "[x]", "not there at all"), ("c", "#", "lead", "head of", "+"), (), ("on",))


@pytest.mark.parametrize("profile", [
    profiles.STRICT, profiles.LOCAL, ODD, RuleProfile(("data",), (), ("oslo", "tx"), ("pune",)), RuleProfile((), (), (), ()),
])
def test_a_table_matches_as_the_patterns_do(spark, profile):
    frame = listings(spark)
    rules = table(spark, own=profile, other=profiles.LOCAL)
    found = rule_table.matched_by_table(frame, rules, "own")
    assert found.columns == frame.columns
    wanted = frame.where(predicates.matches_profile("title", "location", profile))
    assert sorted(r["seq"] for r in found.collect()) == sorted(r["seq"] for r in wanted.collect())


def test_ten_thousand_terms(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(900)]
    terms = sorted({" ".join(rng.sample(words, rng.randint(2, 3))) for _ in range(10_500)})
    out = sorted({" ".join(rng.sample(words, 2)) for _ in range(3000)})
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)]
    profile = RuleProfile(tuple(terms), tuple(out), (), ())
    frame = spark.createDataFrame([(n, t, "") for n, t in enumerate(titles)], LISTING)
    found = rule_table.with_rule_hits(frame, table(spark, p=profile), "p", "seq").collect()
    assert len(terms) > 10_000
    for r in found:
        assert r["included"] == any(t in r["title"] for t in terms)
        assert r["excluded"] == any(t in r["title"] and re.search(rf"\b{t}\b", r["title"]) for t in out)
    assert {r["excluded"] for r in found} == {True, False}


def test_rules_are_not_collected_and_common_keys_are_dealt_out(spark):
    frame = spark.range(4000).selectExpr("id AS seq", "'common words here' AS title", "'' AS location").repartition(4)
    rules = table(spark, p=RuleProfile(("common words",), (), (), ()))
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    result = rule_table.with_rule_hits(frame, rules, "p", "seq")
    assert len(jobs.getJobIdsForGroup(None)) == before
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert result.where("included").count() == 4000


def test_places_of_a_whole_list(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"), F.lit("x").alias("w"))
    found = numbered(rows, [F.col("v").desc()], "place", str(tmp_path / "a"))
    assert found.columns == ["v", "w", "place"]
    assert all(r["place"] == 5000 - r["v"] for r in found.collect()) and found.count() == 5000
    assert numbered(rows.where("false"), [F.col("v")], "place", str(tmp_path / "b")).count() == 0


def test_the_best_rows_and_the_count_come_from_one_pass(spark):
    rows = spark.range(0, 3000, 1, 12).selectExpr(
        "id AS first_seq", "'u' AS flag_status", "CAST(NULL AS STRING) AS location", "false AS cap_exempt",
        "CAST(NULL AS STRING) AS salary", "(id * 7919) % 3000 AS age_days",
    )
    top = rank.top_listings(rank.alertable(rows), 25)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") <= 2  # in the initial and, under adaptive planning, the current plan
    found = top.orderBy("rank_no").collect()
    assert [r["age_days"] for r in found] == list(range(25))
    assert {r["extra"] for r in found} == {2975} and [r["rank_no"] for r in found] == list(range(1, 26))
    assert rank.top_listings(rank.alertable(rows.where("false")), 25).count() == 0


def test_keys_of_texts_are_never_sent_whole_to_every_executor(spark, tmp_path):
    """A small file of texts has many keys; the planner must not take these for small."""
    spark.range(2000).selectExpr("id AS seq", "'common words ' || id AS title", "'' AS location").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    names = spark.range(500).selectExpr("'p' AS profile", "'include' AS kind", "0 AS ord", "'words ' || id AS term")
    plan = rule_table.with_rule_hits(frame, names, "p", "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2


def test_a_long_term_is_found_by_a_long_key(spark):
    texts = spark.range(300).selectExpr("id AS row", "'for customer#' || lpad(id, 9, '0') AS title_low", "'' AS location_low")
    rows = [("p", "include", n, f"Customer#{n:09d}") for n in range(300)] + [("p", "include", 0, "é"), ("p", "allow", 0, "")]
    terms = rule_table._terms(spark.createDataFrame(rows, rule_table.RULE_SCHEMA), "p")
    probes = rule_table._probes(texts, terms)
    picked = rule_table._rarest(terms, probes)
    assert picked.where("kind = 'include'").count() == 300
    assert probes.join(picked.where("kind = 'include'"), "key").count() < 300 * 11  # with keys of three letters: 16,000


def test_only_keys_that_terms_have_are_counted_and_moved(spark):
    texts = spark.range(500).selectExpr("id AS row", "'a title of many other words for customer#' || lpad(id, 9, '0') AS title_low", "'austin, tx' AS location_low")
    rules = [("p", "include", n, f"Customer#{n:09d}") for n in range(500)] + [("p", "block", 0, "pune")]
    terms = rule_table._terms(spark.createDataFrame(rules, rule_table.RULE_SCHEMA), "p")
    assert rule_table._probes(texts, terms).count() < 500 * 4  # three of a title's keys are a name's; all of them: 22,000


@pytest.mark.parametrize("most", [0, 5])
def test_terms_that_are_not_sent_to_the_texts_are_joined(spark, monkeypatch, most):
    """Whichever way a term meets the texts, the rows are those of the patterns."""
    monkeypatch.setattr(rule_table, "BROADCAST_ROWS", most)
    frame = listings(spark)
    profile = RuleProfile(ODD.include[:5] + ("engineer", "data"), ("c", "#", "senior", "vp"), ("tx", "remote"), ("on", "pune"))
    found = rule_table.matched_by_table(frame, table(spark, own=profile, other=profiles.LOCAL), "own")
    wanted = frame.where(predicates.matches_profile("title", "location", profile))
    assert sorted(r["seq"] for r in found.collect()) == sorted(r["seq"] for r in wanted.collect()) != []


def test_no_more_terms_than_set_are_sent_to_the_texts(spark, monkeypatch):
    monkeypatch.setattr(rule_table, "BROADCAST_ROWS", 20)
    texts = spark.range(200).selectExpr("id AS row", "'name ' || (id % 100) || ' data engineer' AS title_low", "'' AS location_low")
    rules = [("p", "include", n, f"name {n} ") for n in range(100)] + [("p", "exclude", n, w) for n, w in enumerate(("data", "engineer", "none"))]
    terms = rule_table._terms(spark.createDataFrame(rules, rule_table.RULE_SCHEMA), "p")
    picked = rule_table._rarest(terms, rule_table._probes(texts, terms)).collect()
    sent = {r["term"] for r in picked if r["common"]}
    assert {"data", "engineer"} <= sent and len(sent) <= 20 and len(picked) == 102


def test_of_equally_rare_keys_the_least_is_taken(spark):
    """Terms are picked more than once; another key the second time would lose their pairs."""
    texts = spark.range(40).selectExpr("id AS row", "'the long name ' || id AS title_low", "'' AS location_low")
    terms = rule_table._terms(spark.createDataFrame([("p", "include", 0, "the long name"), ("p", "exclude", 0, "long name")], rule_table.RULE_SCHEMA), "p")
    least = {r["term"]: min(r["keys"]) for r in terms.collect()}
    for n in (1, 7):
        probes = rule_table._probes(texts.repartition(n), terms)
        assert {r["term"]: r["key"] for r in rule_table._rarest(terms.repartition(n, "term"), probes).collect()} == least


def test_keys_of_bytes_find_terms_between_longer_characters(spark):
    titles = ("Ingénieur données – sénior", "データ エンジニア (senior)", "Müller & Söhne: data engineer", "𝕏 data – engineer", "SÃO PAULO ANALYST", "é analyst", "plain")
    frame = spark.createDataFrame([(n, t, p) for n, (t, p) in enumerate((t, p) for t in titles for p in ("São Paulo", "Köln", "", "Austin, TX"))], LISTING)
    profile = RuleProfile(("données", "エンジニア", "söhne: data", "𝕏", "é", "analyst"), ("sénior", "senior", "são"), ("são", "köln", "tx"), ("ö",))
    found = rule_table.matched_by_table(frame, table(spark, own=profile), "own")
    wanted = frame.where(predicates.matches_profile("title", "location", profile))
    assert sorted(r["seq"] for r in found.collect()) == sorted(r["seq"] for r in wanted.collect()) != []
