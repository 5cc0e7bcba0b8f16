"""Listing predicates. Every function returns a BOOLEAN column that is never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsift.functions import regex
from feedsift.functions.text import _column, folded, trim_spaces
from feedsift.rules import profiles, regions, signals
from feedsift.rules.profiles import RuleProfile


def _or_empty(value: Column | str) -> Column:
    return F.coalesce(_column(value), F.lit(""))


def contains_any(text: Column | str, terms) -> Column:
    """True when the lower-case text holds any term (case of the terms is ignored)."""
    terms = [t.lower() for t in terms]
    if not terms:
        return F.lit(False)
    return F.lower(_or_empty(text)).rlike(regex.any_of(terms))


def title_included(title: Column | str, profile: RuleProfile = profiles.STRICT) -> Column:
    return contains_any(title, profile.include)


def title_exempt(title: Column | str) -> Column:
    return F.lower(_or_empty(title)).rlike(regex.jvm(profiles.EXEMPT_PATTERN))


def title_excluded(title: Column | str, profile: RuleProfile = profiles.STRICT) -> Column:
    """Whole-word test; an exempt title is not held against its exempt terms."""
    lowered = F.lower(_or_empty(title))

    def holds(terms) -> Column:
        return lowered.rlike(regex.jvm(regex.whole_word(terms))) if terms else F.lit(False)

    always = [t for t in profile.exclude if t.lower() not in profiles.EXEMPT_TERMS]
    waivable = [t for t in profile.exclude if t.lower() in profiles.EXEMPT_TERMS]
    if not waivable:
        return holds(always)
    return holds(always) | (holds(waivable) & ~title_exempt(title))


def location_blocked(location: Column | str, block=profiles.BLOCK_TERMS) -> Column:
    return contains_any(location, block)


def looks_us(location: Column | str) -> Column:
    location = _or_empty(location)
    words = "|".join((regions.US_COUNTRY_PATTERN, regions.US_REMOTE_PATTERN))
    codes = r"\b(?:" + "|".join(regions.US_STATE_CODES) + r")\b"
    return (
        F.lower(location).rlike(regex.jvm(words))
        | contains_any(location, regions.US_STATE_NAMES)
        | location.rlike(regex.jvm(codes))
    )


def location_allowed(location: Column | str, allow=()) -> Column:
    """Unknown and "N locations" pass; otherwise the allow terms, or the region test when there are none."""
    trimmed = trim_spaces(F.lower(_or_empty(location)))
    unknown = (trimmed == "") | trimmed.rlike(regex.jvm(regions.OPAQUE_LOCATION_PATTERN))
    named = contains_any(trimmed, allow) if allow else looks_us(location)
    return unknown | named


def matches_profile(
    title: Column | str, location: Column | str, profile: RuleProfile = profiles.STRICT
) -> Column:
    return (
        title_included(title, profile)
        & ~title_excluded(title, profile)
        & ~location_blocked(location, profile.block)
        & location_allowed(location, profile.allow)
    )


def in_priority_region(location: Column | str) -> Column:
    """A named signal, or a ring city with no namesake state next to it."""
    location = _or_empty(location)

    def found(pattern: str) -> Column:
        return location.rlike(regex.jvm(pattern, ignore_case=True))

    def names(words) -> str:
        return r"\b(?:" + "|".join(words) + r")\b"

    def codes(letters) -> str:
        return r",\s*(?:" + "|".join(letters) + r")\b"

    elsewhere = [c for c in regions.US_STATE_CODES if c not in regions.PRIORITY_CODES]
    signal = names(regions.PRIORITY_NAMES) + "|" + codes(regions.PRIORITY_CODES)
    other = codes(elsewhere) + "|" + names(regions.NAMESAKE_STATES)
    return found(signal) | (found(names(regions.RING_CITIES)) & ~found(other))


def matches_by_region(
    title: Column | str,
    location: Column | str,
    strict: RuleProfile = profiles.STRICT,
    local: RuleProfile = profiles.LOCAL,
) -> Column:
    """Match against the local profile inside the priority region, the strict one elsewhere.

    Where both profiles share their location rules those are tested once.
    """
    near = in_priority_region(location)

    def title_ok(profile: RuleProfile) -> Column:
        return title_included(title, profile) & ~title_excluded(title, profile)

    def place_ok(profile: RuleProfile) -> Column:
        return ~location_blocked(location, profile.block) & location_allowed(
            location, profile.allow
        )

    # The titles come first: most rows fail there and need no location test.
    any_title = contains_any(title, strict.include + local.include)
    by_title = any_title & F.when(near, title_ok(local)).otherwise(title_ok(strict))
    if (strict.block, strict.allow) == (local.block, local.allow):
        return by_title & place_ok(strict)
    return by_title & F.when(near, place_ok(local)).otherwise(place_ok(strict))


def location_still_ok(
    location: Column | str,
    remote: Column | str,
    strict: RuleProfile = profiles.STRICT,
    local: RuleProfile = profiles.LOCAL,
) -> Column:
    """Second location test, on the resolved location; remote roles skip the allow test only."""
    remote = F.coalesce(_column(remote), F.lit(False))

    def place_ok(profile: RuleProfile) -> Column:
        return ~location_blocked(location, profile.block) & (
            remote | location_allowed(location, profile.allow)
        )

    if (strict.block, strict.allow) == (local.block, local.allow):
        return place_ok(strict)
    return F.when(in_priority_region(location), place_ok(local)).otherwise(place_ok(strict))


def recent_enough(age: Column | str, max_days: int = signals.MAX_AGE_DAYS) -> Column:
    """An unknown age passes."""
    return F.coalesce(_column(age) <= max_days, F.lit(True))


def not_flagged(status: Column | str) -> Column:
    return ~_column(status).eqNullSafe(F.lit(signals.FLAGGED))


def holds_all(text: Column, words) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words])


def mentions_remote(text: Column | str, low: Column | None = None) -> Column:
    """True when the wording marks the role as remote. ``low``: the folded text, if at hand."""
    low = F.coalesce(folded(text) if low is None else low, F.lit(""))
    tests = [
        holds_all(low, needs) & low.rlike(regex.jvm(pattern))
        for needs, pattern in zip(signals.REMOTE_NEEDS, signals.REMOTE_PATTERNS)
    ]
    return reduce(lambda a, b: a | b, tests)
