"""Tables kept between runs: fresh listings, tracker rows, messages, and the list of finished runs.

Every table is Parquet partitioned by ``job`` and ``run_id``. A job is what
belongs to one checkpoint, or a name the caller gives; runs of different jobs
never share a partition, whatever their numbers. A run rewrites its own
partition only and as a whole, so a run that is repeated leaves the tables as
one run would have, also if it now has no rows.

A run writes several tables. It counts as done when its row is in the table of
finished runs, which is written last; ``finished`` shows a table without the
rows of runs that died half-way.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedsift.session import delete_folder, folders_like

SEEN_SCHEMA = "listing_key STRING, company STRING, title STRING, seen_at TIMESTAMP_NTZ"
RUN_KEYS = ("job", "run_id")


@dataclass(frozen=True)
class Run:
    """A run of a job."""

    job: str
    number: int

    def own(self) -> Column:
        """Whether a table's row was written by this run."""
        return (F.col("job") == self.job) & (F.col("run_id") == self.number)


def job_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the job a checkpoint belongs to; kept in the checkpoint, so a new one is a new job."""
    path = f"{checkpoint}/job"
    known = read_table(spark, path, "job STRING").first()
    if known:
        return known["job"]
    name = uuid.uuid4().hex
    spark.range(1).select(F.lit(name).alias("job")).write.mode("overwrite").parquet(path)
    return name


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at ``path``, or an empty one before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_run(rows: DataFrame, path: str, run: Run, *partitions: str) -> None:
    """Replace the partition of ``run``, also by nothing."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/job={run.job}/run_id={run.number}")


def withdraw(spark: SparkSession, runs: str, run: Run) -> None:
    """Make a run that is repeated count as not done until it is done again."""
    delete_folder(spark, f"{runs}/job={run.job}/run_id={run.number}")


def finish(spark: SparkSession, runs: str, run: Run) -> None:
    """The last write of a run: from here on its rows are seen."""
    write_run(spark.range(1).coalesce(1).select(F.lit(True).alias("done")), runs, run)


def is_finished(spark: SparkSession, runs: str, run: Run) -> bool:
    """Whether the one file of the run's row is there."""
    return bool(folders_like(spark, f"{runs}/job={run.job}/run_id={run.number}/part-*"))


def finished(rows: DataFrame, runs: str) -> DataFrame:
    """Rows of finished runs. ``runs`` has one narrow row per run, so its size decides how they meet."""
    done = read_table(rows.sparkSession, runs, "done BOOLEAN, job STRING, run_id BIGINT").select(*RUN_KEYS)
    return rows.join(done, list(RUN_KEYS), "left_semi")


def seen_rows(fresh: DataFrame, seen_at: Column) -> DataFrame:
    """Rows to record; keys are unique after the run's dedup."""
    return fresh.select("listing_key", "company", "title", seen_at.alias("seen_at"))
