"""Flattened details kept in buckets by key, so that a join moves the listings and leaves the details where they are.

A store is a folder of Parquet files, one per bucket, each sorted by key. A
session opens it as a table, which tells the planner how it is dealt out: the
side of the details is then read without an exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feedsift.operators.enrich import latest_details

BUCKETS = 32
COLUMNS = "detail_key STRING, description STRING, locations ARRAY<STRING>"


def write_details(details: DataFrame, path: str, buckets: int = BUCKETS, order: str = "landed_at") -> None:
    """Store the latest detail of each key below ``path``, in place of what is there."""
    spark, name = details.sparkSession, f"details_{uuid.uuid4().hex}"
    rows = latest_details(details, order).repartition(buckets, "detail_key")
    rows.write.mode("overwrite").bucketBy(buckets, "detail_key").sortBy("detail_key").option("path", path).saveAsTable(name)
    # The files stay; the name is this session's only.
    spark.sql(f"DROP TABLE {name}")


def open_details(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The details stored below ``path`` with this number of buckets."""
    name = f"details_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (detail_key) SORTED BY (detail_key) "
        f"INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
