"""Alert order and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.functions import extract, predicates
from feedsift.operators.ordinal import numbered
from feedsift.rules import signals

RANK_FIELDS = ("rank_flagged", "rank_elsewhere", "rank_not_exempt", "rank_floor", "rank_age")
# Fixed by Spark: a row id is the task's number above this many bits and the row's number below.
_ROW_BITS = 33
_TASK_GROUPS = 256


def with_rank_fields(listings: DataFrame) -> DataFrame:
    """The five sort keys, each computed once per row."""
    flagged = F.col("flag_status").eqNullSafe(F.lit(signals.FLAGGED))
    near = predicates.in_priority_region("location")
    exempt = F.coalesce("cap_exempt", F.lit(False))
    return listings.withColumns(
        {
            "rank_flagged": flagged.cast("int"),
            "rank_elsewhere": (~near).cast("int"),
            "rank_not_exempt": (~exempt).cast("int"),
            "rank_floor": F.coalesce(extract.money_value("salary"), F.lit(0.0)),
            "rank_age": F.coalesce(
                "age_days", F.lit(signals.UNKNOWN_AGE_RANK).cast("long")
            ),
        }
    )


def rank_order(tie: str = "first_seq") -> list[Column]:
    return [
        F.col("rank_flagged").asc(),
        F.col("rank_elsewhere").asc(),
        F.col("rank_not_exempt").asc(),
        F.col("rank_floor").desc(),
        F.col("rank_age").asc(),
        F.col(tie).asc(),
    ]


def alertable(
    listings: DataFrame, skip_flagged: bool = False, max_days: int | None = None
) -> DataFrame:
    """Rows to alert on, with their sort keys, not yet sorted."""
    if max_days is not None:
        listings = listings.where(predicates.recent_enough("age_days", max_days))
    if skip_flagged:
        listings = listings.where(predicates.not_flagged("flag_status"))
    return with_rank_fields(listings)


def ranked(listings: DataFrame, tie: str = "first_seq") -> DataFrame:
    """Whole list in alert order: a range-partitioned sort, ties by first position.

    A global sort reads its input twice, first for a sample of the keys. The
    rows are rebalanced before it, so that the second reading starts from
    shuffled rows and not from the texts the keys were read from.
    """
    return listings.hint("rebalance").orderBy(*rank_order(tie))


def top_listings(
    listings: DataFrame, limit: int = signals.MAX_SHOWN, tie: str = "first_seq"
) -> DataFrame:
    """First ``limit`` rows with ``rank_no`` and ``extra``, the count of those left out.

    One pass. A task sorts its rows, so that a row's number within the task says
    whether it is among its best, and hands on their count and those rows only.
    Tasks are first put together in groups, so that no task gathers the best
    rows of all others.
    """
    best_first = listings.sortWithinPartitions(*rank_order(tie)).withColumn("_row", F.monotonically_increasing_id())
    task, place = F.shiftrightunsigned("_row", _ROW_BITS), F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    order = F.struct(
        *RANK_FIELDS[:3], (-F.col("rank_floor")).alias("rank_floor"), "rank_age", F.col(tie).alias("tie")
    )
    found = F.struct(order.alias("order"), F.struct(*listings.columns).alias("row"))

    def first(rows: Column) -> Column:
        return F.slice(F.array_sort(rows), 1, limit)

    groups = best_first.groupBy(F.pmod(task, F.lit(_TASK_GROUPS)).alias("_group")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(place < limit, found)).alias("best")
    )
    whole = groups.select("n", first(F.col("best")).alias("best")).agg(
        F.sum("n").alias("n"), first(F.flatten(F.collect_list("best"))).alias("best")
    )
    extra = F.greatest(F.col("n") - limit, F.lit(0).cast("long"))
    return whole.select(extra.alias("extra"), F.posexplode("best").alias("place", "found")).select(
        "found.row.*", (F.col("place") + 1).alias("rank_no"), "extra"
    )


def positions(listings: DataFrame, path: str, tie: str = "first_seq") -> DataFrame:
    """The whole list with ``rank_no``, stored below ``path``."""
    return numbered(listings, rank_order(tie), "rank_no", path)
