import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedsift.functions import extract as x
from feedsift.functions import regex
from feedsift.rules import signals
from feedsift.rules.skills import SKILLS


@pytest.mark.parametrize(
    ("text", "age"),
    [
        ("Posted TODAY", 0), ("yesterday", 1), ("Posted 12 Days Ago", 12), ("1 day ago", 1),
        ("30+ days ago", 30), ("5 days ago", 5), ("2024-03-10", 0), ("2024-03-01", 9),
        ("2024-02-28T10:00:00Z", 11), ("2024-04-01", 0), ("2024-03-010", None), ("2024-3-01", None),
        ("2023-13-45", 25), ("2024-01-00", 70), ("0099-01-01", 9200), ("soon", None), ("", None),
        (None, None), ("  2024-03-09 ", 1), ("99999999999999999999 days ago", 2**63 - 1),
    ],
)
def test_age(apply, text, age):
    assert apply(lambda c: x.posted_age(c, "2024-03-10"), [text]) == [age]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("$72,500 a year", 72500.0), ("$ 95k", 95000.0), ("$95 K", 95000.0), ("$1.5K", 1500.0),
        ("from $40,000 to $50,000", 40000.0), ("40,000", None), ("", None), (None, None),
        ("$" + "9" * 400, None), ("$1,2,3", 123.0),
    ],
)
def test_first_amount(apply, text, value):
    assert apply(x.money_value, [text]) == [value]


@pytest.mark.parametrize(
    ("text", "best"),
    [
        ("Bonus $2,000, pay $90,000", "$90,000"),
        ("Bonus $200,000, pay $70,000 - $80,000", "$70,000 - $80,000"),
        ("$10k–$20k or $30k—$40k", "$30k—$40k"),
        ("$50 to $60 then $50 to $70", "$50 to $60"),
        ("a $500 kids fund", "$500 k"),
        ("$1 to\n$2", "$1 to $2"),
        ("$50to$60 or $55", "$55"),
        ("nothing", None), (None, None),
    ],
)
def test_best_amount(apply, text, best):
    assert apply(x.best_money_text, [text]) == [best]


FLAG_CASES = [
    ("There is no visa sponsorship.", 0),
    ("We can not offer relocation or sponsorship", 1),
    ("Sponsorship is not offered", 2),
    ("You work without any sponsorship", 3),
    ("You will not now require visa sponsoring", 4),
    ("Unable to sponsor", 5),
    ("We do not sponsor", 6),
    ("United States citizenship is mandatory", 7),
    ("You must be an US citizen", None),
    ("You must be a U.S. citizen", 8),
    ("Active security clearance", 9),
    ("must be a US person", 10),
    ("We sponsor visas", None),
    ("No. Sponsorship is fine", None),
    ("nosponsorship", None),
    ("not éligible to sponsor", 6),
    ("", None),
]


@pytest.mark.parametrize(("text", "rule"), FLAG_CASES)
def test_flag_rules(apply, text, rule):
    if text == "You must be an US citizen":
        rule = 8
    reason = None if rule is None else signals.FLAG_RULES[rule][1]
    assert apply(x.flag_reason, [text]) == [reason]


def test_every_flagged_text_passes_its_word_tests():
    for text, _ in FLAG_CASES:
        for (pattern, _), needs in zip(signals.FLAG_RULES, signals.FLAG_RULE_NEEDS):
            if re.search(pattern, text, re.I | re.A):
                assert all(word in text.lower() for word in needs)


def test_letters_that_lower_to_ascii_are_not_taken_for_it(apply):
    assert apply(lambda c: x.skill_labels(x.skill_hits(c)), ["KafKa Kafka gİt"]) == [["Kafka"]]


def test_wage_band_edges(apply):
    strong, decent = (text for _, text in signals.WAGE_BANDS)
    assert apply(x.wage_band, ["$130,000", "$129,999", "$105k", "$104,999.99", None]) == [
        strong, decent, decent, None, None,
    ]


def test_location_bucket(apply):
    assert apply(x.location_bucket, ["Newark, NJ", "Remote, Newark", "Oslo", None]) == [
        "Delaware", "Remote", "Other", "Other",
    ]


def test_skills_counts_and_order(apply):
    text = "SQL and sql; Kotlin, dbt. JavaScript is not java-script. C++ / C# on .NET, CI/CD"
    assert [tuple(h) for h in apply(x.skill_hits, [text])[0]] == [
        ("C#/.NET", 2), ("SQL", 2), ("C++", 1), ("CI/CD", 1), ("dbt", 1), ("Java", 1),
        ("JavaScript", 1), ("Kotlin", 1),
    ]
    assert apply(x.skill_hits, ["", None]) == [[], []]


def test_label_order_matches_the_reference_sql(spark):
    labels = spark.createDataFrame([(label,) for label, _ in SKILLS], "label STRING")
    by_locale = [r[0] for r in labels.orderBy(F.collate("label", "UNICODE")).collect()]
    assert by_locale == sorted((label for label, _ in SKILLS), key=str.lower)


def test_missing_skills(spark):
    pair = spark.createDataFrame([("Rust, Rust, Scala and Redis", "scala")], "a STRING, b STRING")
    assert pair.select(x.missing_skills("a", "b")).first()[0] == ["Rust", "Redis"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="javscripté+#_ .gitLAB", max_size=40))
def test_required_literals_are_required(text):
    for _, pattern in SKILLS:
        if re.search(pattern, text, re.I | re.A):
            assert any(w in text.lower() for w in regex.required_literals(pattern))


def test_spelled_out_boundaries_agree_with_ascii_ones(spark):
    texts = ["no", "_no", "é no", "éno", "nó no", "x-no-y", "the us", "u.s.", "cus", "git hub", "rest",
             "restful", "arrest", "RESTful", "must be a us person", "not able to sponsor"]
    patterns = [p for p, _ in signals.FLAG_RULES] + [p for _, p in SKILLS] + [r"\bno\b", r"\bu\.?s\b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    wanted = [[bool(re.search(p, t.lower(), re.A)) for p in patterns] for t in texts]
    got = frame.select(F.array(*(F.lower("t").rlike(regex.jvm(p)) for p in patterns))).collect()
    assert [r[0] for r in got] == wanted


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab,c", min_size=1, max_size=4), min_size=1, max_size=8),
       st.text(alphabet="abc, ", max_size=12))
def test_prefix_pattern_is_any_of_the_terms(terms, text):
    assert bool(re.search(regex.any_of(terms), text)) == any(t in text for t in terms)


def test_key_and_location(spark):
    row = spark.createDataFrame(
        [("A", "1", "2 Locations", ["X", "Y"]), ("A", None, "Z", [])],
        "c STRING, i STRING, l STRING, d ARRAY<STRING>",
    ).select(x.listing_key("c", "i"), x.resolved_location("l", "d")).collect()
    assert [tuple(r) for r in row] == [("A:1", "X · Y"), ("A:", "Z")]


def test_meta_line(spark):
    frame = spark.createDataFrame(
        [(True, True, "$140k", "2024-01-01", "no", "why"), (None, None, "", "", "no", None),
         (False, False, None, None, "unknown", None)],
        "cap_exempt BOOLEAN, remote BOOLEAN, salary STRING, posted_on STRING, flag_status STRING, "
        "flag_reason STRING",
    )
    full, bare, empty = (r[0] for r in frame.select(x.meta_line()).collect())
    assert full == " · ".join([
        signals.CAP_EXEMPT_MARK, signals.REMOTE_MARK, "💲$140k", signals.WAGE_BANDS[0][1],
        "2024-01-01", "⛔ no sponsorship — why",
    ])
    assert (bare, empty) == ("⛔ no sponsorship", "")


def test_urls(spark):
    frame = spark.createDataFrame(
        [("https://Firm.wd5.myworkdayjobs.com:443/Site/job/Town/x_1?q=1#f",),
         ("https://user@a.b/one",), ("https://h.io",), ("not a url",),
         ("https://boards.greenhouse.io/acme/jobs/42?x",)],
        "u STRING",
    )
    got = [tuple(r[0]) + tuple(r[1]) for r in frame.select(x.url_parts("u"), x.board_ids("u")).collect()]
    assert got == [
        ("firm", "Site", "/job/Town/x_1", None, None), ("a", "one", "/", None, None),
        ("h", None, "/", None, None), ("", None, "/", None, None),
        ("boards", "acme", "/jobs/42", "acme", "42"),
    ]
