"""Detail attachment and the signals read from descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.functions import extract, predicates
from feedsift.functions.text import folded
from feedsift.operators.columns import computed_once


def detail_key() -> Column:
    """Where a listing's detail is found; null when the text is inline or there is none."""
    inline = F.coalesce(F.col("description"), F.lit("")) != ""
    return (
        F.when(inline, F.lit(None).cast("string"))
        .when(F.contains("url", F.lit("myworkdayjobs.com")), F.col("url"))
        .otherwise(
            F.coalesce(F.nullif("oracle_detail", F.lit("")), F.nullif("detail_api", F.lit("")))
        )
    )


def latest_details(details: DataFrame, order: Column | str = "landed_at") -> DataFrame:
    """One detail per key, the latest by ``order`` when a key landed more than once."""
    order = F.col(order) if isinstance(order, str) else order
    picked = F.max_by(F.struct("description", "locations"), order).alias("_detail")
    return details.groupBy("detail_key").agg(picked).select("detail_key", "_detail.*")


def _attached(joined: DataFrame) -> DataFrame:
    """Description, location and ``has_detail`` of rows beside the detail found for them."""
    inline = F.nullif("description", F.lit(""))
    return joined.withColumns(
        {
            "description": F.coalesce(inline, F.col("_description")),
            "location": extract.resolved_location("location", "_locations"),
            "has_detail": inline.isNotNull() | F.col("_description").isNotNull(),
        }
    ).drop("detail_key", "_description", "_locations")


def _found(details: DataFrame) -> DataFrame:
    return details.select(
        "detail_key", F.col("description").alias("_description"), F.col("locations").alias("_locations")
    )


def attach_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Left join of flattened details (unique ``detail_key``).

    Adds ``has_detail``; ``description`` and ``location`` become the detail's
    where it has them. A row that needs no detail gets a made-up key of its
    own, so that a feed with inline texts does not meet in one task of the join.
    """
    spread = F.concat(F.lit("\u0000"), F.xxhash64("listing_key").cast("string"))
    keyed = listings.withColumn("detail_key", F.coalesce(detail_key(), spread))
    return _attached(keyed.join(_found(details), "detail_key", "left"))


def attach_stored_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """As ``attach_details``, for details in a store: they do not move, and neither do rows that need none.

    Rows with a text of their own, or without a detail, go past the join.
    ``listings`` is read twice for that, so it should be stored. The rows of one
    key meet in the task of its bucket; where a single detail belongs to a large
    part of all listings, ``attach_details`` lets the planner split them.
    """
    keyed = listings.withColumn("detail_key", detail_key())
    joined = keyed.where("detail_key IS NOT NULL").join(_found(details), "detail_key", "left")
    past = keyed.where("detail_key IS NULL").withColumns(
        {"_description": F.lit(None).cast("string"), "_locations": F.lit(None).cast("array<string>")}
    )
    return _attached(joined.unionByName(past))


def with_signals(listings: DataFrame, text: str = "description") -> DataFrame:
    """Flag, salary and remote columns from the text. No text: status unknown, the rest null.

    The folded text is made once and shared by all patterns.
    """
    low = F.col("_low")
    remote = predicates.mentions_remote(text, low)
    scanned = computed_once(
        listings.withColumn("_low", folded(text)),
        {
            "flag_reason": extract.flag_reason(text, low),
            "salary": extract.best_money_text(text),
            "remote": F.when(F.col(text).isNotNull(), remote),
        },
    )
    return scanned.drop("_low").withColumn("flag_status", extract.flag_status("flag_reason"))
