"""Counts and health roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsift.rules import signals
from feedsift.rules.feeds import UNKNOWN_SOURCE


def _is_flagged() -> Column:
    return F.col("flag_status").eqNullSafe(F.lit(signals.FLAGGED))


def flag_breakdown(listings: DataFrame) -> DataFrame:
    return listings.agg(
        F.count_if(~_is_flagged()).alias("n_open"), F.count_if(_is_flagged()).alias("n_flagged")
    )


def source_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source_ord").agg(F.count(F.lit(1)).alias("n_rows"))


def run_counters(
    fetched: DataFrame,
    matches: DataFrame,
    failures: DataFrame,
    skip_flagged: bool = False,
    max_shown: int = signals.MAX_SHOWN,
    fresh: DataFrame | None = None,
) -> DataFrame:
    """One row of run counters, in one aggregate over narrow rows of all inputs.

    ``fresh``: the fresh ones of ``matches``. Without it ``matches`` carries a
    BOOLEAN ``is_fresh``.
    """
    if fresh is None:
        fresh = matches.where("is_fresh")
    to_alert = ~_is_flagged() if skip_flagged else F.lit(True)
    marks = {
        "fetched": (fetched, F.lit(True)),
        "matched": (matches, F.lit(True)),
        "flagged": (matches, _is_flagged()),
        "fresh": (fresh, F.lit(True)),
        "alertable": (fresh, to_alert),
        "failed": (failures, F.col("source_failed")),
    }
    rows = []
    for frame in (fetched, matches, fresh, failures):
        own = [(mark if of is frame else F.lit(False)).alias(name) for name, (of, mark) in marks.items()]
        rows.append(frame.select(*own))
    told = reduce(lambda a, b: a.unionAll(b), rows)
    totals = told.agg(*(F.count_if(name).alias(name) for name in marks))
    return totals.withColumn("shown", F.least(F.col("alertable"), F.lit(max_shown).cast("long")))


def source_health(
    pages: DataFrame, dimension: DataFrame, n_sources: int, checked=("workday",)
) -> DataFrame:
    """Per run and source entry: ok / bad / not checked, largest total, and the run's bad count.

    Every entry of the dimension (numbered from 0 to ``n_sources`` - 1) shows up
    in every run, with pages or without; a source with pages that is no entry is
    bad. The window over a run sees one row per source.
    """
    keys = ["run_id", "source_ord"]
    stats = pages.groupBy(*keys).agg(
        F.bool_or(~F.col("failed")).alias("any_ok"),
        F.max(F.when(~F.col("failed"), F.col("total"))).alias("largest"),
    )
    entries = F.sequence(F.lit(0).cast("long"), F.lit(n_sources - 1).cast("long"))
    expected = stats.select("run_id").distinct().select("run_id", F.explode(entries).alias("source_ord"))
    expected = expected.union(stats.select(*keys)).distinct()
    rows = expected.join(dimension.select("source_ord", "company", "ats"), "source_ord", "left").join(
        stats.withColumnsRenamed({k: f"_{k}" for k in keys}),
        (F.col("run_id") == F.col("_run_id")) & F.col("source_ord").eqNullSafe(F.col("_source_ord")),
        "left",
    )
    is_known = F.col("company").isNotNull()
    is_checked = F.col("ats").isin(*checked)
    is_ok = F.coalesce(F.col("any_ok"), F.lit(False))
    is_bad = F.count_if(F.col("status") == "bad").over(Window.partitionBy("run_id"))
    return rows.select(
        "run_id",
        "source_ord",
        F.coalesce("company", F.lit(UNKNOWN_SOURCE)).alias("company"),
        F.when(is_known & ~is_checked, "not checked").when(is_known & is_ok, "ok").otherwise("bad").alias("status"),
        F.when(is_checked, F.col("largest")).alias("total"),
    ).withColumn("n_bad", is_bad).withColumn("all_healthy", F.col("n_bad") == 0)
