"""Landed pages: bounded pull, term status, and the union of all feeds.

A page row holds ``run_id`` (poll), ``source_ord``, ``term_no``,
``page_offset``, ``payload`` and ``failed``. Pages written by ``land_pages`` hold
``n_rows``, ``total`` and the parsed ``listings`` instead of the payload: paging is
decided from narrow columns, and no payload is parsed a second time.

``caps`` (format -> offset) leaves out pages from that offset on. By default
there are none: a page that has landed counts. ``pages_left_out`` says how many
a cap costs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.operators.dedup import keep_last
from feedsift.rules.feeds import PAGE_SIZES, SEARCH_TERMS
from feedsift.sources.payloads import LISTINGS_TYPE, explode_listings, parse_pages

LANDED_SCHEMA = (
    "run_id BIGINT, source_ord INT, term_no INT, page_offset INT, payload STRING, failed BOOLEAN"
)
STORED_SCHEMA = (
    "run_id BIGINT, source_ord INT, term_no INT, page_offset INT, failed BOOLEAN, n_rows BIGINT, total DOUBLE, "
    f"listings {LISTINGS_TYPE}, ats STRING"
)
TERM_KEYS = ("run_id", "source_ord", "term_key")
MALFORMED = "malformed"
READ_SCHEMA = f"{LANDED_SCHEMA}, {MALFORMED} STRING"
READ_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
Caps = dict[str, int] | None
SEQ_FIELDS = ("run_id", "source_ord", "term_no", "page_offset", "pos")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON-lines files; the schema is given, so no pass is spent on inferring it."""
    return marked_failed(spark.read.schema(READ_SCHEMA).options(**READ_OPTIONS).json(path))


def marked_failed(raw: DataFrame) -> DataFrame:
    """Lines that are no page count as failed pages of an unknown source; ``raw`` has READ_SCHEMA."""
    broken = F.col(MALFORMED).isNotNull()
    return raw.withColumns(
        {
            "payload": F.when(broken, F.col(MALFORMED)).otherwise(F.col("payload")),
            "page_offset": F.when(broken, F.lit(0)).otherwise(F.col("page_offset")),
            "failed": broken | F.coalesce("failed", F.lit(False)),
        }
    ).drop(MALFORMED)


def with_source(pages: DataFrame, dimension: DataFrame, *columns: str) -> DataFrame:
    """Attach source columns by entry. Pages of an unknown source have none, and count as failed.

    Columns the pages hold already (a stored table's ``ats`` partition) stay.
    """
    missing = [c for c in columns if c not in pages.columns]
    known = dimension.select("source_ord", *missing).withColumn("_known", F.lit(True))
    failed = F.coalesce("failed", F.lit(False)) | F.col("_known").isNull()
    return pages.join(known, "source_ord", "left").withColumn("failed", failed).drop("_known")


def is_paged() -> Column:
    return F.coalesce(F.col("ats").isin(*PAGE_SIZES), F.lit(False))


def _by_format(values: dict[str, int]) -> Column:
    cases = [(F.col("ats") == ats, value) for ats, value in values.items()]
    (first, value), rest = cases[0], cases[1:]
    return reduce(lambda column, case: column.when(*case), rest, F.when(first, value))


def with_term_key(pages: DataFrame) -> DataFrame:
    """Formats polled per term keep their term; a board is one unit whatever files it landed in."""
    return pages.withColumn("term_key", F.when(is_paged(), F.col("term_no")).otherwise(F.lit(-1)))


def within_cap(caps: Caps = None) -> Column:
    if not caps:
        return F.lit(True)
    return F.coalesce(F.col("page_offset") < _by_format(caps), F.lit(True))


def pages_left_out(pages: DataFrame, caps: Caps = None) -> DataFrame:
    """One row: how many landed pages lie beyond the caps."""
    return pages.agg(F.count_if(~within_cap(caps)).alias("pages_left_out"))


def term_status(pages: DataFrame, caps: Caps = None) -> DataFrame:
    """Per unit polled: the offset its paging stops at, and whether it failed.

    Takes pages with ``n_rows``, ``total`` and ``failed`` (see ``parse_pages``).
    Paging stops at the first page that failed, is empty, or reaches the total
    (a missing total counts as 0). A unit fails when the page it stops at
    failed, a board when any of its files did. Partial aggregation keeps this
    to one row per unit and task, however many pages a unit has.
    """
    reaches_total = F.col("page_offset") + _by_format(PAGE_SIZES) >= F.coalesce(F.col("total"), F.lit(0))
    stops = is_paged() & (F.col("failed") | (F.col("n_rows") == 0) | reaches_total)
    failed_at = F.min(F.when(F.col("failed"), F.col("page_offset")))
    return (
        with_term_key(pages.where(within_cap(caps)))
        .groupBy(*TERM_KEYS)
        .agg(
            F.min(F.when(stops, F.col("page_offset"))).alias("stop_offset"),
            failed_at.alias("failed_offset"),
        )
        .select(
            *TERM_KEYS,
            "stop_offset",
            F.coalesce(
                F.col("failed_offset") <= F.coalesce("stop_offset", "failed_offset"), F.lit(False)
            ).alias("term_failed"),
        )
    )


def bounded_pull(pages: DataFrame, status: DataFrame, caps: Caps = None) -> DataFrame:
    """Keep the pages a poll would have fetched; adds ``term_failed``.

    The status side has one narrow row per unit polled. Whether it is
    broadcast is left to its measured size.
    """
    return (
        with_term_key(pages.where(within_cap(caps)))
        .join(status, list(TERM_KEYS))
        .where(F.col("stop_offset").isNull() | (F.col("page_offset") <= F.col("stop_offset")))
        .drop("stop_offset", "term_key")
    )


def pulled_pages(pages: DataFrame, caps: Caps = None, status: DataFrame | None = None) -> DataFrame:
    """Parsed pages of the units that did not fail, up to where their paging stops."""
    status = term_status(pages, caps) if status is None else status
    return bounded_pull(pages, status, caps).where(~F.col("term_failed"))


def source_status(status: DataFrame) -> DataFrame:
    """A source failed when every unit polled for it failed."""
    return status.groupBy("run_id", "source_ord").agg(
        F.bool_and("term_failed").alias("source_failed"),
        F.count_if("term_failed").alias("n_failed_terms"),
    )


def order_of(*fields: str) -> Column:
    return F.struct(*fields)


def union_terms(listings: DataFrame) -> DataFrame:
    """Merge the terms of a source: the last listing per id, at the place of the first."""
    return keep_last(listings, ["run_id", "source_ord", "id"], order_of(*SEQ_FIELDS), "first_seq")


def collect_listings(
    pages: DataFrame, dimension: DataFrame, caps: Caps = None, status: DataFrame | None = None
) -> DataFrame:
    """Stored pages of any format -> listings in polling order (``seq``, ``first_seq``).

    ``status``: the pages' ``term_status`` under the same caps, where the caller has it stored.

    Only formats polled per term are merged by id. Boards pass through, so they
    cost no shuffle here. Pages that still hold payloads are taken too; their
    status and their listings are then two readings of the payload, so a batch
    is better landed first.
    """
    attached = with_source(pages, dimension, "company", "ats", "address", "cap_exempt")
    kept = pulled_pages(attached if "listings" in pages.columns else parse_pages(attached), caps, status)
    carried = (
        "run_id", "source_ord", "term_no", "page_offset", "company", "ats", "cap_exempt",
    )
    per_term = union_terms(explode_listings(kept.where(is_paged()), *carried))
    boards = explode_listings(kept.where(~is_paged()), *carried).withColumn(
        "first_seq", order_of(*SEQ_FIELDS)
    )
    return per_term.unionByName(boards).withColumns(
        {
            "seq": order_of(*SEQ_FIELDS),
            "cap_exempt": F.coalesce("cap_exempt", F.lit(False)),
        }
    )


def land_pages(pages: DataFrame, dimension: DataFrame, path: str) -> None:
    """Parse pages and write them by format, listings beside the counts paging needs."""
    attached = with_source(pages, dimension, "ats", "address")
    parse_pages(attached).drop("address").write.mode("overwrite").partitionBy("ats").parquet(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Pages written by ``land_pages``."""
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def search_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEARCH_TERMS)), "term_no INT, term STRING")
