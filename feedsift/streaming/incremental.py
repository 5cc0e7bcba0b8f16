"""The incremental job: each micro-batch of landed pages is one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from feedsift.operators.digest import digest, email, failure_notice, message_parts
from feedsift.operators.rank import alertable, top_listings
from feedsift.operators.rollup import run_counters
from feedsift.operators.tracker import tracker_rows
from feedsift.plans.run import RunOptions, select_listings
from feedsift.rules.feeds import SOURCES
from feedsift.sources.dimension import source_dimension
from feedsift.sources.landed import (
    READ_OPTIONS,
    READ_SCHEMA,
    collect_listings,
    land_pages,
    marked_failed,
    pages_left_out,
    read_stored,
    source_status,
    term_status,
)
from feedsift.session import delete_folder
from feedsift.streaming.seen import SeenTable
from feedsift.streaming.tables import (
    SEEN_SCHEMA,
    Run,
    finish,
    finished,
    job_of,
    read_table,
    seen_rows,
    withdraw,
    write_run,
)


@dataclass(frozen=True)
class Tables:
    """Folder of the tables a job keeps; it must be reachable by every executor."""

    root: str

    @property
    def seen(self) -> str:
        return f"{self.root}/seen"

    @property
    def fresh(self) -> str:
        return f"{self.root}/fresh"

    @property
    def tracker(self) -> str:
        return f"{self.root}/tracker"

    @property
    def messages(self) -> str:
        return f"{self.root}/messages"

    @property
    def emails(self) -> str:
        return f"{self.root}/emails"

    @property
    def notices(self) -> str:
        return f"{self.root}/notices"

    @property
    def counters(self) -> str:
        return f"{self.root}/counters"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    def scratch(self, name: str, run: Run) -> str:
        """Where a run keeps what it stores for itself; gone when it is done."""
        return f"{self.root}/scratch/{name}/job={run.job}/run_id={run.number}"


def seen_table(spark: SparkSession, tables: Tables) -> SeenTable:
    return SeenTable(spark, tables.seen, SEEN_SCHEMA, runs=tables.runs)


def read_finished(spark: SparkSession, tables: Tables, path: str) -> DataFrame:
    """One of the tables, with the rows of finished runs only."""
    return finished(spark.read.parquet(path), tables.runs)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def record_fresh(chosen: DataFrame, tables: Tables, run: Run, options: RunOptions) -> DataFrame:
    """Diff against the seen table and record what is fresh; returns the stored fresh rows.

    The fresh rows are written first and read back, so the later steps neither
    repeat the run's plan nor depend on cached blocks of an executor that may
    be lost.
    """
    spark = chosen.sparkSession
    seen = seen_table(spark, tables)
    seen.begin(run)
    write_run(seen.unseen(chosen, run), tables.fresh, run)
    kept = [*chosen.schema.fields, StructField("job", StringType()), StructField("run_id", LongType())]
    fresh = read_table(spark, tables.fresh, StructType(kept)).where(run.own()).drop("job", "run_id")
    seen.record(seen_rows(fresh, F.lit(options.as_of).cast("timestamp_ntz")), run)
    return fresh


def emit(
    fresh: DataFrame, tables: Tables, run: Run, options: RunOptions, dimension: DataFrame, dimension_rows: int | None = None
) -> None:
    """Tracker rows of all that is to be alerted, message and e-mail of the first of them."""
    to_alert = alertable(fresh, options.skip_flagged)
    rows = tracker_rows(to_alert, dimension, options.user_id, options.as_of, dimension_rows)
    write_run(rows, tables.tracker, run)
    told = _stored(digest(top_listings(to_alert, options.max_shown)), tables.scratch("digest", run))
    write_run(message_parts(told), tables.messages, run)
    write_run(email(told), tables.emails, run)


def run_pages(
    pages: DataFrame,
    tables: Tables,
    run: Run | int,
    options: RunOptions,
    details: DataFrame | None = None,
    sources=SOURCES,
) -> None:
    """One run over a batch of landed pages.

    The batch is parsed and stored once, by format and with its counts, and so
    are the listings chosen from it: raw files are read and parsed a single
    time, and counting repeats no matching. A seed run records and stays silent. A run given by number
    alone belongs to the job ``batch``.

    The row that says the run is done comes last, so whatever it wrote shows all
    at once: a run that dies on the way has recorded no key and alerted nothing,
    and when it is repeated it replaces what it left. What it stored for itself
    is deleted at the end.
    """
    if isinstance(run, int):
        run = Run("batch", run)
    spark = pages.sparkSession
    withdraw(spark, tables.runs, run)
    dimension = source_dimension(spark, sources)
    land_pages(pages, dimension, tables.scratch("pages", run))
    batch = read_stored(spark, tables.scratch("pages", run))
    status = _stored(term_status(batch, options.caps), tables.scratch("status", run))
    listings = collect_listings(batch, dimension, options.caps, status)
    chosen = select_listings(listings, options, details)
    chosen = _stored(chosen.drop("run_id", "description", "detail_api", "oracle_detail"), tables.scratch("matches", run))
    fresh = record_fresh(chosen, tables, run, options)
    if not options.seed:
        emit(fresh, tables, run, options, dimension, len(sources))
        failures = source_status(status)
        write_run(failure_notice(failures, dimension).drop("run_id"), tables.notices, run)
        counters = run_counters(listings, chosen, failures, options.skip_flagged, options.max_shown, fresh)
        left_out = pages_left_out(batch, options.caps)
        write_run(counters.withColumn("pages_left_out", left_out.scalar()), tables.counters, run)
    finish(spark, tables.runs, run)
    for name in ("pages", "status", "matches", "digest"):
        delete_folder(spark, tables.scratch(name, run))


def start_incremental(
    spark: SparkSession,
    landed_path: str,
    tables: Tables,
    checkpoint: str,
    options: RunOptions,
    details: DataFrame | None = None,
    sources=SOURCES,
    files_per_run: int | None = None,
) -> StreamingQuery:
    """Process every landed file not processed yet, then stop.

    A poll should land as one file, or ``files_per_run`` be left open, so that
    a run sees all pages of a unit together. Runs are numbered within the job
    the checkpoint belongs to; a new checkpoint over the same tables is a new
    job, which finds recorded keys recorded.
    """
    reader = spark.readStream.schema(READ_SCHEMA).options(**READ_OPTIONS)
    job = job_of(spark, checkpoint)
    if files_per_run:
        reader = reader.option("maxFilesPerTrigger", files_per_run)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        run_pages(marked_failed(batch), tables, Run(job, batch_id), options, details, sources)

    return (
        reader.json(landed_path)
        .writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_new_keys(
    spark: SparkSession, path: str, schema: str, key: str, seen_path: str, checkpoint: str
) -> StreamingQuery:
    """Cross-run dedup of a stream of Parquet files: each batch adds its unseen keys to the seen table."""

    job = job_of(spark, checkpoint)

    def add_batch(batch: DataFrame, batch_id: int) -> None:
        run, session = Run(job, batch_id), batch.sparkSession
        seen = SeenTable(session, seen_path, f"{key} STRING", key)
        keys = f"{seen_path}/scratch/job={job}/run_id={batch_id}"
        seen.begin(run)
        seen.record(seen.unseen(_stored(batch.select(key).distinct(), keys), run), run)
        delete_folder(session, keys)

    return (
        spark.readStream.schema(schema)
        .parquet(path)
        .writeStream.foreachBatch(add_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
