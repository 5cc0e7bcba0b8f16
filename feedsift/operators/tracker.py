"""Tracker rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsift.functions.extract import location_bucket
from feedsift.functions.text import join_parts
from feedsift.operators.dedup import lookup_first
from feedsift.rules import signals
from feedsift.rules.feeds import UNKNOWN


def tracker_rows(
    listings: DataFrame,
    dimension: DataFrame,
    user_id: str,
    today: str,
    dimension_rows: int | None = None,
) -> DataFrame:
    """The nine tracker columns. A flagged role overrides the source's sponsors guess."""
    known = lookup_first(
        listings.drop("everify_guess", "sponsors_guess"),
        dimension.select("company", "source_ord", "everify_guess", "sponsors_guess"),
        "company",
        "source_ord",
        {"everify_guess": UNKNOWN, "sponsors_guess": UNKNOWN},
        dimension_rows,
    )
    flagged = F.col("flag_status").eqNullSafe(F.lit(signals.FLAGGED))
    notes = join_parts(
        signals.PART_SEPARATOR,
        F.lit(f"Auto-added by monitor {today}"),
        F.col("location"),
        F.col("posted_on"),
        F.concat(F.lit("Salary "), F.nullif("salary", F.lit(""))),
        F.when(flagged, F.concat(F.lit("⚠ "), F.nullif("flag_reason", F.lit("")))),
    )
    return known.select(
        F.lit(user_id).alias("user_id"),
        "company",
        F.col("title").alias("role"),
        location_bucket("location").alias("location"),
        F.lit("Wishlist").alias("status"),
        F.col("url").alias("link"),
        F.col("everify_guess").alias("everify"),
        F.when(flagged, "No").otherwise(F.col("sponsors_guess")).alias("sponsors"),
        notes.alias("notes"),
    )
