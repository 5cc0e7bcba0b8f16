"""Values read out of listing text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsift.functions import regex
from feedsift.functions.predicates import holds_all
from feedsift.functions.text import _column, folded, join_parts, squeeze, trim_spaces
from feedsift.rules import regions, signals
from feedsift.rules.signals import PART_SEPARATOR
from feedsift.rules.skills import SKILLS

_LONG_MAX = 9223372036854775807


def posted_age(posted_on: Column | str, as_of: Column | str) -> Column:
    """Age in whole days at ``as_of`` (a DATE column or ISO text), null when the text says nothing.

    Month and day overflow roll over into the next unit and two-digit years
    count from 1900, as in calendar arithmetic on UTC milliseconds.
    """
    if isinstance(as_of, str):
        as_of = F.lit(as_of).cast("date")
    text = trim_spaces(F.lower(F.coalesce(_column(posted_on), F.lit(""))))
    ago = regex.jvm(signals.DAYS_AGO_PATTERN)
    iso = regex.jvm(signals.ISO_DATE_PATTERN)

    def part(group: int) -> Column:
        return F.regexp_extract(text, iso, group).try_cast("int")

    year = F.when(part(1) < 100, part(1) + 1900).otherwise(part(1))
    first_day = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(2) - 1)
    day = F.date_add(first_day, part(3) - 1)
    days_ago = F.regexp_extract(text, ago, 1)
    return (
        F.when(F.contains(text, F.lit("today")), F.lit(0).cast("long"))
        .when(F.contains(text, F.lit("yesterday")), F.lit(1).cast("long"))
        .when(days_ago != "", F.coalesce(days_ago.try_cast("long"), F.lit(_LONG_MAX)))
        .when(text.rlike(iso), F.greatest(F.lit(0), F.datediff(as_of, day)).cast("long"))
    )


def money_value(text: Column | str) -> Column:
    """First dollar amount as DOUBLE, thousands suffix applied; null when there is none."""
    parts = regex.jvm(signals.AMOUNT_PARTS_PATTERN)
    digits = F.regexp_extract(_column(text), parts, 1)
    number = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    suffix = F.regexp_extract(_column(text), parts, 2)
    value = F.when(suffix != "", number * 1000.0).otherwise(number)
    return F.when(value < float("inf"), value)


def best_money_text(text: Column | str) -> Column:
    """The most salary-like amount or range: ranges first, then the larger, then the earlier."""
    hits = F.regexp_extract_all(
        _column(text), F.lit(regex.jvm(signals.AMOUNT_OR_RANGE_PATTERN)), F.lit(0)
    )

    def scored(hit: Column, pos: Column) -> Column:
        shown = F.trim(squeeze(hit))
        bonus = F.when(shown.rlike(regex.jvm(signals.RANGE_MARK_PATTERN)), signals.RANGE_BONUS)
        score = F.coalesce(bonus, F.lit(0.0)) + F.coalesce(money_value(shown), F.lit(0.0))
        return F.struct(score.alias("score"), (-pos).alias("earliness"), shown.alias("shown"))

    return F.array_max(F.transform(hits, scored))["shown"]


def flag_reason(text: Column | str, low: Column | None = None) -> Column:
    """Reason of the first flag rule that hits, else null. ``low``: the folded text, if at hand."""
    low = folded(text) if low is None else low
    return F.coalesce(
        *(
            F.when(holds_all(low, needs) & low.rlike(regex.jvm(pattern)), F.lit(reason))
            for needs, (pattern, reason) in zip(signals.FLAG_RULE_NEEDS, signals.FLAG_RULES)
        )
    )


def flag_status(reason: Column | str) -> Column:
    return F.when(_column(reason).isNotNull(), signals.FLAGGED).otherwise(signals.UNFLAGGED)


def wage_band(salary: Column | str) -> Column:
    floor = money_value(salary)
    (high, high_text), (mid, mid_text) = signals.WAGE_BANDS
    return F.when(floor >= high, high_text).when(floor >= mid, mid_text)


def location_bucket(location: Column | str) -> Column:
    lowered = F.lower(F.coalesce(_column(location), F.lit("")))
    out = None
    for bucket, words in regions.LOCATION_BUCKETS:
        hit = lowered.rlike(regex.any_of(words))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out.otherwise(regions.LOCATION_BUCKET_DEFAULT)


def listing_key(company: Column | str, listing_id: Column | str) -> Column:
    """Source-namespaced key; a missing part counts as empty so the key is never null."""
    return F.concat(
        F.coalesce(_column(company), F.lit("")),
        F.lit(":"),
        F.coalesce(_column(listing_id), F.lit("")),
    )


def skill_hits(text: Column | str, low: Column | None = None, skills=SKILLS) -> Column:
    """Skills found, as ARRAY<STRUCT<label, n>>, most frequent first, then by label in locale order.

    A pattern scans a text only when the text holds a literal the pattern
    starts with, so texts without skills cost plain substring searches.
    ``low``: the folded text, if at hand.
    """
    low = folded(text) if low is None else low

    def count(pattern: str) -> Column:
        scan = F.regexp_count(low, F.lit(regex.jvm(pattern))).cast("long")
        literals = regex.required_literals(pattern)
        if literals is None:
            return scan
        return F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in literals)), scan)

    counted = F.array(
        *(
            F.struct(F.lit(label).alias("label"), count(pattern).alias("n"))
            for label, pattern in skills
        )
    )
    sortable = F.transform(
        F.filter(counted, lambda h: h["n"] > 0),
        lambda h: F.struct(
            (-h["n"]).alias("order_n"), F.collate(h["label"], "UNICODE").alias("order_label")
        ),
    )
    return F.transform(
        F.array_sort(sortable),
        lambda h: F.struct(
            F.collate(h["order_label"], "UTF8_BINARY").alias("label"),
            (-h["order_n"]).alias("n"),
        ),
    )


def skill_labels(hits: Column | str) -> Column:
    return F.transform(_column(hits), lambda h: h["label"])


def missing_skills(wanted_text: Column | str, own_text: Column | str) -> Column:
    """Labels found in the first text and not in the second, in the order of the first."""
    return F.array_except(
        skill_labels(skill_hits(wanted_text)), skill_labels(skill_hits(own_text))
    )


def resolved_location(location: Column | str, detail_locations: Column | str) -> Column:
    names = _column(detail_locations)
    return F.when(F.size(names) > 0, F.array_join(names, PART_SEPARATOR)).otherwise(
        _column(location)
    )


def meta_line(listing: dict[str, Column] | None = None) -> Column:
    """Display line of a listing. ``listing`` maps column names to columns when they differ."""
    def named(name: str) -> Column:
        return (listing or {}).get(name, F.col(name))

    salary = F.nullif(named("salary"), F.lit(""))
    reason = F.nullif(named("flag_reason"), F.lit(""))
    flagged = named("flag_status").eqNullSafe(F.lit(signals.FLAGGED))
    return join_parts(
        PART_SEPARATOR,
        F.when(named("cap_exempt"), signals.CAP_EXEMPT_MARK),
        F.when(named("remote"), signals.REMOTE_MARK),
        F.concat(F.lit(signals.SALARY_MARK), salary),
        wage_band(salary),
        named("posted_on"),
        F.when(
            flagged,
            F.concat(
                F.lit(signals.FLAG_TEXT), F.coalesce(F.concat(F.lit(" — "), reason), F.lit(""))
            ),
        ),
    )


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_parts(url: Column | str) -> Column:
    """STRUCT<tenant, site, rest>: first host label, first path segment, remaining path."""
    host = F.lower(F.regexp_extract(_column(url), _HOST, 1))
    path = F.regexp_extract(_column(url), _PATH, 1)
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.struct(
        F.split(host, r"\.", -1)[0].alias("tenant"),
        F.get(segments, F.lit(0)).alias("site"),
        F.concat(
            F.lit("/"),
            F.array_join(
                F.when(F.size(segments) > 1, F.slice(segments, 2, F.size(segments))).otherwise(
                    F.array().cast("array<string>")
                ),
                "/",
            ),
        ).alias("rest"),
    )


def board_ids(url: Column | str) -> Column:
    """STRUCT<board, listing> from a board URL; both null when it is not one."""
    pattern = r"greenhouse\.io/([^/]+)/jobs/(\d+)"
    return F.struct(
        F.nullif(F.regexp_extract(_column(url), pattern, 1), F.lit("")).alias("board"),
        F.nullif(F.regexp_extract(_column(url), pattern, 2), F.lit("")).alias("listing"),
    )
