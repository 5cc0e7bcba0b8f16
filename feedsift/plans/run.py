"""A whole run as one declarative plan: match, dedupe, age, enrich, re-check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from feedsift.operators.enrich import attach_details, latest_details, with_signals
from feedsift.operators.matching import deduplicated, matched, recent, rechecked, with_age
from feedsift.operators.rank import alertable, ranked
from feedsift.rules import profiles, signals


@dataclass(frozen=True)
class RunOptions:
    """Parameters of a run. ``as_of`` (ISO date) stands for today."""

    as_of: str
    max_age_days: int = signals.MAX_AGE_DAYS
    max_shown: int = signals.MAX_SHOWN
    skip_flagged: bool = False
    seed: bool = False
    user_id: str = "owner"
    caps: dict[str, int] | None = None  # format -> offset from which pages are left out
    strict: profiles.RuleProfile = profiles.STRICT
    local: profiles.RuleProfile = profiles.LOCAL


def select_listings(
    listings: DataFrame,
    options: RunOptions,
    details: DataFrame | None = None,
    seq: Column | str = "seq",
) -> DataFrame:
    """Listings that pass every stage, enriched.

    The order of stages is part of the result (dedup keeps the last matching
    row) and also the cheap one: names and dates are tested before any
    description is joined or scanned. Without ``details`` the inline
    descriptions are used; with them (``detail_key``, ``description``,
    ``locations``, ``landed_at``) the latest of a key counts.
    """
    kept = matched(listings, options.strict, options.local)
    kept = recent(with_age(deduplicated(kept, seq), options.as_of), options.max_age_days)
    if details is not None:
        kept = attach_details(kept, latest_details(details))
    return rechecked(with_signals(kept), options.strict, options.local)


def preview(
    listings: DataFrame,
    options: RunOptions,
    details: DataFrame | None = None,
    seq: Column | str = "seq",
) -> DataFrame:
    """What a run would alert on if nothing had been seen before, in alert order. Writes nothing."""
    chosen = select_listings(listings, options, details, seq).drop("description")
    return ranked(alertable(chosen, options.skip_flagged))
