"""Tables an operator stores between its jobs, and row identity."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.session import shared_folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back.

    A lost executor costs at most the stage that writes; nothing is recomputed
    from the inputs later. The driver removes the folder when it ends.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system remove ``path`` when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def text_key(text: str = "text") -> Column:
    """Tells texts of rows with one doc_id apart; with doc_id it names a row.

    Rows equal in both are repeated rows and share every result.
    """
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed for them."""
    root = str(Path(__file__).resolve().parents[2])
    place = spark.sparkContext.environment
    if root not in place.get("PYTHONPATH", "").split(":"):
        place["PYTHONPATH"] = ":".join(filter(None, (place.get("PYTHONPATH"), root)))
