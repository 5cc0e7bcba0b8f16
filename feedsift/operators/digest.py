"""Digest texts over a bounded, ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.functions.extract import meta_line
from feedsift.functions.text import chunk_text, escape_html
from feedsift.rules import signals
from feedsift.rules.feeds import UNKNOWN_SOURCE


def _flag_tag() -> Column:
    flagged = F.col("flag_status").eqNullSafe(F.lit(signals.FLAGGED))
    return F.when(flagged, signals.FLAG_MARK + " ").otherwise("")


def _safe(name: str) -> Column:
    return escape_html(F.coalesce(F.col(name), F.lit("")))


def _meta(before: str) -> Column:
    meta = F.col("meta")
    return F.when(meta != "", F.concat(F.lit(before), escape_html(meta))).otherwise("")


def _url() -> Column:
    return F.coalesce(F.col("url"), F.lit(""))


def text_entry() -> Column:
    return F.concat(
        _flag_tag(), F.lit("<b>"), _safe("company"), F.lit("</b>: "), _safe("title"),
        F.lit("\n  "), _safe("location"), _meta("\n  "), F.lit("\n  "), _url(),
    )


def html_entry() -> Column:
    return F.concat(
        F.lit("<li>"), _flag_tag(), F.lit("<strong>"), _safe("company"), F.lit("</strong> — "),
        F.lit('<a href="'), _url(), F.lit('">'), _safe("title"), F.lit("</a><br><small>"),
        _safe("location"), _meta(" · "), F.lit("</small></li>"),
    )


def digest(top: DataFrame) -> DataFrame:
    """One row (n_shown, extra, text_message, html_message); no row when the list is empty.

    ``top`` comes from ``top_listings``, so what is gathered here is at most
    the number of rows a digest shows.
    """
    entries = top.withColumn("meta", meta_line()).select(
        "rank_no", "extra", "flag_status", text_entry().alias("entry"), html_entry().alias("item")
    )
    gathered = entries.agg(
        F.count(F.lit(1)).alias("n_shown"),
        F.count_if(~F.col("flag_status").eqNullSafe(F.lit(signals.FLAGGED))).alias("n_open"),
        F.max("extra").alias("extra"),
        F.expr("listagg(entry, '\n\n') WITHIN GROUP (ORDER BY rank_no)").alias("body"),
        F.expr("listagg(item, '') WITHIN GROUP (ORDER BY rank_no)").alias("items"),
    ).where(F.col("n_shown") > 0)

    def text(value: str) -> Column:
        return F.lit(value)

    n_all = (F.col("n_shown") + F.col("extra")).cast("string")
    counts = F.concat(
        F.col("n_open").cast("string"), text(" sponsorable, "),
        (F.col("n_shown") - F.col("n_open")).cast("string"), text(" flagged"),
    )
    more = F.concat(text("…and "), F.col("extra").cast("string"), text(" more — see the tracker."))
    has_more = F.col("extra") > 0
    return gathered.select(
        "n_shown",
        "extra",
        F.concat(
            text("🔔 "), n_all, text(" new role(s) — "), counts, text(":\n\n"), F.col("body"),
            F.when(has_more, F.concat(text("\n\n"), more)).otherwise(""),
        ).alias("text_message"),
        F.concat(
            text("<p>"), n_all, text(" new role(s) matched — "), counts, text(":</p><ul>"),
            F.col("items"), text("</ul>"),
            F.when(has_more, F.concat(text("<p>"), more, text("</p>"))).otherwise(""),
        ).alias("html_message"),
    )


def email(digests: DataFrame) -> DataFrame:
    """Subject and body of the digest as an e-mail."""
    n_all = (F.col("n_shown") + F.col("extra")).cast("string")
    return digests.select(F.concat(n_all, F.lit(" new job match(es)")).alias("subject"), F.col("html_message").alias("html"))


def message_parts(digests: DataFrame, limit: int = signals.MESSAGE_LIMIT) -> DataFrame:
    """The text message cut to the size limit, one row per part."""
    return digests.select(
        F.posexplode(chunk_text("text_message", limit)).alias("part_no", "part")
    )


def failure_notice(
    failures: DataFrame, dimension: DataFrame, at_least: int = signals.FAILURE_WARNING_AT
) -> DataFrame:
    """Per run: count and names of failed sources, when there are enough of them.

    A run has at most one row per entry of the source dimension here; pages of
    no entry are named as such.
    """
    failed = failures.where("source_failed").join(
        dimension.select("source_ord", "company"), "source_ord", "left"
    ).withColumn("company", F.coalesce("company", F.lit(UNKNOWN_SOURCE)))
    return (
        failed.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("n_failed"),
            F.expr("listagg(company, ', ') WITHIN GROUP (ORDER BY source_ord)").alias("names"),
        )
        .where(F.col("n_failed") >= at_least)
        .select(
            "run_id",
            "n_failed",
            F.concat(
                F.lit("⚠️ "), F.col("n_failed").cast("string"),
                F.lit(" sources failed to fetch this run: "), F.col("names"),
            ).alias("notice"),
        )
    )
