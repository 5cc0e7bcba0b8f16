"""Deduplication, lookups and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.session import BROADCAST_ROWS


def keep_last(
    rows: DataFrame,
    keys: list[str],
    order: Column,
    first_name: str = "first_seq",
    place: Column | None = None,
) -> DataFrame:
    """The last row per key by ``order``, at the place of the key's first row.

    ``place`` says where a row stands; it is ``order`` unless an earlier merge
    has given rows a place that is not their own.

    One shuffle. Each task reduces its rows to one per key before it, so a key
    that holds a large share of all rows sends one row per task. ``order`` must
    be unique within a key.
    """
    others = [c for c in rows.columns if c not in keys and c != first_name]
    last = F.max_by(F.struct(*others), order)
    return rows.groupBy(*keys).agg(
        last.alias("_last"), F.min(order if place is None else place).alias(first_name)
    ).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in others), first_name)


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``seen``.

    Only the key column of ``seen`` is read. An anti join keeps the row side
    splittable when one key is hot.
    """
    return rows.join(seen.select(key), key, "left_anti")


def lookup_first(
    rows: DataFrame,
    dimension: DataFrame,
    on: str,
    order: str,
    defaults: dict[str, object],
    dimension_rows: int | None = None,
) -> DataFrame:
    """Left lookup by a name that may repeat: the dimension's first row wins, misses get defaults.

    ``dimension_rows``: row count of the dimension where the caller knows it; a
    small one is broadcast, otherwise the join is planned by measured size.
    """
    names = list(defaults)
    first = dimension.groupBy(on).agg(
        F.min_by(F.struct(*names), F.col(order)).alias("_found")
    )
    if dimension_rows is not None and dimension_rows <= BROADCAST_ROWS:
        first = F.broadcast(first)
    found = {n: F.coalesce(F.col(f"_found.{n}"), F.lit(defaults[n])) for n in names}
    return rows.join(first, on, "left").withColumns(found).drop("_found")
