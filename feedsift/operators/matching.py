"""Filters over listing frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.functions import extract, predicates
from feedsift.operators.dedup import keep_last
from feedsift.rules import profiles, signals


def matched(
    listings: DataFrame,
    strict: profiles.RuleProfile = profiles.STRICT,
    local: profiles.RuleProfile = profiles.LOCAL,
) -> DataFrame:
    return listings.where(predicates.matches_by_region("title", "location", strict, local))


def deduplicated(listings: DataFrame, seq: Column | str = "seq") -> DataFrame:
    """Last row per listing key. Runs after the filter: the survivor is the last *matching* row.

    Rows merged before keep the first place they have in ``first_seq``.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    keyed = listings.withColumn("listing_key", extract.listing_key("company", "id"))
    place = F.col("first_seq") if "first_seq" in listings.columns else None
    return keep_last(keyed, ["listing_key"], order, place=place)


def with_age(listings: DataFrame, as_of: Column | str) -> DataFrame:
    return listings.withColumn("age_days", extract.posted_age("posted_on", as_of))


def recent(listings: DataFrame, max_days: int = signals.MAX_AGE_DAYS) -> DataFrame:
    return listings.where(predicates.recent_enough("age_days", max_days))


def rechecked(
    listings: DataFrame,
    strict: profiles.RuleProfile = profiles.STRICT,
    local: profiles.RuleProfile = profiles.LOCAL,
) -> DataFrame:
    """Second location filter, on the location the detail resolved."""
    return listings.where(predicates.location_still_ok("location", "remote", strict, local))
