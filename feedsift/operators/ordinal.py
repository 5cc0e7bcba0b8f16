"""Numbers for the rows of a whole list in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed by Spark: a row id is the task's number above this many bits and the row's number below.
_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, path: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 1, as ``name``.

    The list is sorted over ranges and stored with each row's number within its
    task. A task's rows begin after those of the tasks before it; these sums are
    taken over one number per task and joined back, so no task sees the whole list.
    ``order`` must be unique, or the places of equal rows are any of theirs.
    """
    spark = rows.sparkSession
    ordered = rows.hint("rebalance").orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    ordered.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path).withColumns(
        {"_task": F.shiftrightunsigned("_row", _ROW_BITS), "_place": F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)}
    )
    sizes = stored.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return stored.join(starts, "_task").withColumn(name, F.col("_start") + F.col("_place") + 1).drop(
        "_task", "_place", "_start", "_row"
    )
