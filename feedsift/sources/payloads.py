"""Listing payloads of each format -> one listing shape.

Payload fields are read as text whatever their JSON type, so a board that
sends a number where another sends a string is still read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.rules.signals import PART_SEPARATOR

_CORRUPT = "_corrupt_record"
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}

# Payload fields of all formats. The names of their lists differ, so one schema reads any
# payload; that of lever is a bare list and is read as one named ``postings``.
PAGE_SCHEMA = (
    "total STRING, jobPostings ARRAY<STRUCT<title STRING, externalPath STRING, "
    "locationsText STRING, postedOn STRING, bulletFields ARRAY<STRING>>>, "
    "jobs ARRAY<STRUCT<id STRING, title STRING, location STRUCT<name STRING>, "
    "absolute_url STRING, updated_at STRING>>, "
    "postings ARRAY<STRUCT<id STRING, text STRING, categories STRUCT<location STRING>, "
    "hostedUrl STRING, createdAt STRING, descriptionPlain STRING>>, "
    "items ARRAY<STRUCT<TotalJobsCount STRING, requisitionList ARRAY<STRUCT<Id STRING, "
    "Title STRING, PrimaryLocation STRING, PostedDate STRING, ExternalPostedStartDate STRING, "
    "secondaryLocations ARRAY<STRUCT<Name STRING>>>>>>, "
    f"{_CORRUPT} STRING"
)
LISTING_FIELDS = (
    "id", "title", "location", "url", "posted_on", "detail_api", "oracle_detail", "description",
)
_MILLIS_PER_DAY = 86_400_000


def _listing(**fields: Column) -> Column:
    return F.struct(
        *(fields.get(f, F.lit(None).cast("string")).alias(f) for f in LISTING_FIELDS)
    )


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _address(pos: int) -> Column:
    return _text(F.get(F.col("address"), F.lit(pos)))


def _workday(parsed: Column) -> Column:
    prefix = F.concat(
        F.lit("https://"), _address(0), F.lit("."), _address(1),
        F.lit(".myworkdayjobs.com/"), _address(2),
    )
    return F.transform(
        parsed["jobPostings"],
        lambda j: _listing(
            id=F.coalesce(F.nullif(F.get(j["bulletFields"], F.lit(0)), F.lit("")), j["externalPath"]),
            title=j["title"],
            location=_text(j["locationsText"]),
            url=F.concat(prefix, j["externalPath"]),
            posted_on=_text(j["postedOn"]),
        ),
    )


def _greenhouse(parsed: Column) -> Column:
    api = F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), _address(0), F.lit("/jobs/"))
    return F.transform(
        parsed["jobs"],
        lambda j: _listing(
            id=j["id"],
            title=_text(j["title"]),
            location=_text(j["location"]["name"]),
            url=j["absolute_url"],
            posted_on=F.left(_text(j["updated_at"]), F.lit(10)),
            detail_api=F.concat(api, j["id"]),
        ),
    )


def _epoch_millis_day(millis: Column) -> Column:
    """UTC day of an epoch-millisecond value, independent of the session's time zone."""
    days = F.floor(millis / _MILLIS_PER_DAY).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def _lever(parsed: Column) -> Column:
    return F.transform(
        parsed["postings"],
        lambda j: _listing(
            id=j["id"],
            title=_text(j["text"]),
            location=_text(j["categories"]["location"]),
            url=j["hostedUrl"],
            posted_on=_text(
                _epoch_millis_day(F.nullif(j["createdAt"].try_cast("bigint"), F.lit(0).cast("bigint")))
            ),
            description=_text(j["descriptionPlain"]),
        ),
    )


def _oracle(parsed: Column) -> Column:
    host, site = _address(0), _address(1)
    view = F.concat(
        F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/")
    )
    detail = F.concat(
        F.lit("https://"), host,
        F.lit("/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?expand=all&finder=ById;Id=%22"),
    )
    return F.transform(
        F.get(parsed["items"], F.lit(0))["requisitionList"],
        lambda r: _listing(
            id=r["Id"],
            title=_text(r["Title"]),
            location=F.array_join(
                F.filter(
                    F.concat(
                        F.array(r["PrimaryLocation"]),
                        F.coalesce(
                            F.transform(r["secondaryLocations"], lambda s: s["Name"]),
                            F.array().cast("array<string>"),
                        ),
                    ),
                    lambda n: n != "",
                ),
                PART_SEPARATOR,
            ),
            url=F.concat(view, r["Id"]),
            posted_on=F.left(
                F.coalesce(r["ExternalPostedStartDate"], r["PostedDate"], F.lit("")), F.lit(10)
            ),
            oracle_detail=F.concat(detail, r["Id"], F.lit("%22,siteNumber="), site),
        ),
    )


_NORMALISERS = {
    "workday": _workday, "greenhouse": _greenhouse, "lever": _lever, "oracle": _oracle,
}


_LISTS = {
    "workday": lambda parsed: parsed["jobPostings"],
    "greenhouse": lambda parsed: parsed["jobs"],
    "lever": lambda parsed: parsed["postings"],
    "oracle": lambda parsed: F.get(parsed["items"], F.lit(0))["requisitionList"],
}
LISTINGS_TYPE = "ARRAY<STRUCT<" + ", ".join(f"{name}: STRING" for name in LISTING_FIELDS) + ">>"


def _by_format(values: dict[str, Column]) -> Column:
    """The value of a page's own format, null where the format has no reader."""
    return F.coalesce(*(F.when(F.col("ats") == ats, value) for ats, value in values.items()))


def parse_pages(pages: DataFrame) -> DataFrame:
    """``n_rows``, ``total``, ``failed`` and ``listings`` in place of ``payload``.

    Needs ``ats``, ``address`` and ``payload``. The payload is parsed here, once,
    and nowhere else: what is stored or passed on holds listings of one shape
    (``LISTINGS_TYPE``). A payload that is missing, not JSON or holds something
    else than a list where a format has its listings marks the page failed. A
    page of a format without a reader has no listings and does not fail.
    """
    known_failed = F.col("failed") if "failed" in pages.columns else F.lit(False)
    body = F.when(F.col("ats") == "lever", F.concat(F.lit('{"postings":'), "payload", F.lit("}"))).when(
        F.col("ats").isin(*_LISTS), F.col("payload")
    )
    page = F.col("_page")
    unreadable = F.coalesce(F.col("ats").isin(*_LISTS), F.lit(False)) & (page.isNull() | page[_CORRUPT].isNotNull())
    sizes = _by_format({ats: F.size(F.coalesce(rows_of(page), F.array())) for ats, rows_of in _LISTS.items()})
    total = F.coalesce(page["total"], F.get(page["items"], F.lit(0))["TotalJobsCount"])
    listings = _by_format({ats: normalise(page) for ats, normalise in _NORMALISERS.items()})
    kept = [c for c in pages.columns if c not in ("payload", "failed")]
    return pages.withColumn("_page", F.from_json(body, PAGE_SCHEMA, _PERMISSIVE)).select(
        *kept,
        (F.coalesce(known_failed, F.lit(False)) | unreadable).alias("failed"),
        F.coalesce(sizes, F.lit(0)).cast("long").alias("n_rows"),
        total.try_cast("double").alias("total"),
        F.when(~unreadable, listings).alias("listings"),
    )


def explode_listings(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per listing of parsed pages, with ``pos`` (place on its page) and the ``keep`` columns."""
    return pages.select(*keep, F.posexplode("listings").alias("pos", "listing")).select(
        *keep, "pos", *(F.col(f"listing.{f}").alias(f) for f in LISTING_FIELDS)
    )


def explode_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """Listings of pages that still hold their ``payload``; pages that cannot be read have none."""
    return explode_listings(parse_pages(pages), *keep)
