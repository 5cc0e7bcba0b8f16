"""Detail payloads -> plain description and location names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.functions.text import decode_entities, strip_tags

# Payload fields per format.
DETAIL_SCHEMAS = {
    "workday": (
        "jobPostingInfo STRUCT<jobDescription STRING, location STRING, "
        "additionalLocations ARRAY<STRING>>"
    ),
    "greenhouse": "content STRING, location STRUCT<name STRING>",
    "oracle": (
        "items ARRAY<STRUCT<ExternalDescriptionStr STRING, ExternalQualificationsStr STRING, "
        "ExternalResponsibilitiesStr STRING, PrimaryLocation STRING, "
        "secondaryLocations ARRAY<STRUCT<Name STRING>>>>"
    ),
}
_ORACLE_TEXTS = (
    "ExternalDescriptionStr", "ExternalQualificationsStr", "ExternalResponsibilitiesStr",
)


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _names(first: Column, others: Column) -> Column:
    return F.filter(
        F.concat(F.array(first), F.coalesce(others, F.array().cast("array<string>"))),
        lambda n: n != "",
    )


def flatten_details(details: DataFrame) -> DataFrame:
    """(detail_key, ats, payload, …) -> adds ``description`` and ``locations``, drops ``payload``.

    A payload that is missing or not JSON gives no row: its listing is then
    treated as one without a detail.
    """
    parsed = {
        f"_{ats}": F.when(
            F.col("ats") == ats,
            F.from_json("payload", f"{schema}, _corrupt_record STRING",
                        {"columnNameOfCorruptRecord": "_corrupt_record"}),
        )
        for ats, schema in DETAIL_SCHEMAS.items()
    }
    info, board = F.col("_workday.jobPostingInfo"), F.col("_greenhouse")
    item = F.get(F.col("_oracle.items"), F.lit(0))
    by_format = {
        "workday": (
            strip_tags(_text(info["jobDescription"])),
            _names(info["location"], info["additionalLocations"]),
        ),
        "greenhouse": (
            strip_tags(decode_entities(_text(board["content"]))),
            _names(board["location"]["name"], F.lit(None).cast("array<string>")),
        ),
        "oracle": (
            strip_tags(F.concat_ws(" ", *(item[name] for name in _ORACLE_TEXTS))),
            _names(
                item["PrimaryLocation"],
                F.transform(item["secondaryLocations"], lambda s: s["Name"]),
            ),
        ),
    }
    description = locations = None
    readable = F.lit(False)
    for ats, (text, names) in by_format.items():
        own = F.col("ats") == ats
        whole = F.col(f"_{ats}").isNotNull() & F.col(f"_{ats}._corrupt_record").isNull()
        readable = readable | (own & whole)
        description = F.when(own, text) if description is None else description.when(own, text)
        locations = F.when(own, names) if locations is None else locations.when(own, names)
    return (
        details.withColumns(parsed)
        .where(readable)
        .withColumns({"description": description, "locations": locations})
        .drop("payload", *parsed)
    )
