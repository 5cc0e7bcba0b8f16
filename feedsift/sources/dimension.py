"""The source dimension and rule profiles kept as tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.rules.feeds import SOURCES
from feedsift.rules.profiles import RuleProfile
from feedsift.session import BROADCAST_ROWS, delete_folder, folders_like, mounted_folder

# The table of the files in a folder of texts; readers of the folder skip its name.
LISTING = "_files"
FILES_PER_FOLDER = 10_000
# Bytes of texts sent on at once; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20
# Bytes of files a task reads, where there are enough for all cores.
TASK_BYTES = 32 << 20

SOURCE_SCHEMA = (
    "source_ord INT, company STRING, ats STRING, address ARRAY<STRING>, "
    "everify_guess STRING, sponsors_guess STRING, cap_exempt BOOLEAN"
)


def source_dimension(spark: SparkSession, sources=SOURCES) -> DataFrame:
    """One row per source entry; ``source_ord`` is its place in the polling order.

    The row count is known here, so the broadcast hint is given only while it
    is small; a longer list is left to the join planning.
    """
    rows = [
        (ord_no, name, ats, list(address), everify, sponsors, exempt)
        for ord_no, (name, ats, address, everify, sponsors, exempt) in enumerate(sources)
    ]
    frame = spark.createDataFrame(rows, SOURCE_SCHEMA)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame


def load_profile(rules: DataFrame, name: str) -> RuleProfile:
    """Build a profile from a rule table (profile, kind, ord, term).

    A profile is configuration: its terms, however many, become part of the plan.
    """
    rows = rules.where(F.col("profile") == name).select("kind", "ord", "term").collect()
    ordered = sorted(rows, key=lambda r: r["ord"])

    def terms(kind: str) -> tuple[str, ...]:
        return tuple(r["term"] for r in ordered if r["kind"] == kind)

    return RuleProfile(terms("include"), terms("exclude"), terms("allow"), terms("block"))


def write_whole_texts(rows: DataFrame, key: str, text: str, path: str) -> None:
    """One file per row that has a key; every file ends with a line break of its own.

    Below a mounted folder the tasks write the files themselves and list them,
    with their keys, in the table ``_files``. A task names its folders anew, and
    only files of tasks that ended are listed, so a repeated task does no harm.
    On other file systems Spark writes a folder named by ``key`` per text.
    """
    spark, rows = rows.sparkSession, rows.where(F.col(key).isNotNull()).select(key, text)
    base = mounted_folder(spark, path)
    if base is None:
        rows.write.mode("overwrite").partitionBy(key).text(path)
        return
    delete_folder(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = uuid.uuid4().hex, 0
        for batch in batches:
            names, sizes = [], []
            for no, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{task}-{n // FILES_PER_FOLDER}"
                if n % FILES_PER_FOLDER == 0:
                    os.makedirs(f"{base}/{folder}")
                name, content = f"{folder}/{quote(str(no), safe='')[:100]}.{n}.txt", value.as_buffer() or b""
                with open(f"{base}/{name}", "xb") as out:
                    out.write(content)
                    out.write(b"\n")
                names.append(name)
                sizes.append(len(content) + 1)
                n += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=[key, "file", "n_bytes"]
            )

    schema = f"`{key}` {dict(rows.dtypes)[key]}, file string, n_bytes bigint"
    content = rows.select(key, F.col(text).cast("binary"))
    content.mapInArrow(run, schema).write.parquet(f"{path}/{LISTING}")


def _read_listed(spark: SparkSession, path: str, base: str) -> DataFrame:
    """The keys, ``file_name`` and content (``value``) of the files listed in ``_files``, read by tasks of even size.

    A file that is gone, or not as long as it was when written, fails the task.
    """
    listed = spark.read.parquet(f"{path}/{LISTING}")
    key = listed.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values, start, held = [], [], 0, 0

            def found(end: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(names, pa.string()), pa.array(values, pa.binary())],
                    names=[key, "file_name", "value"],
                )

            for at, (file, size) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if names and held + size > BATCH_BYTES:
                    yield found(at)
                    names, values, start, held = [], [], at, 0
                with open(f"{base}/{file}", "rb") as source:
                    value = source.read()
                if len(value) != size:
                    raise ValueError(f"{base}/{file} holds {len(value)} bytes, {size} were written")
                names.append(os.path.basename(file))
                values.append(value)
                held += size
            yield found(batch.num_rows)

    n_bytes = listed.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(n_bytes // TASK_BYTES, spark.sparkContext.defaultParallelism)
    schema = f"`{key}` {dict(listed.dtypes)[key]}, file_name string, value binary"
    return listed.repartition(tasks, "file").mapInArrow(run, schema).withColumn("value", F.col("value").cast("string"))


def read_whole_texts(spark: SparkSession, path: str, ends_with_break: bool = False) -> DataFrame:
    """One row per file: ``file_name``, the whole content in ``text``, and the keys the files were written with.

    Files listed in a table are read by its rows, without looking through the
    folder. In other folders Spark finds the files, and folders name the keys;
    there many small files share a task, as the session's settings for splits
    say. A file is never cut. ``ends_with_break``: leave out the break that text
    files end with.
    """
    base = mounted_folder(spark, path)
    if base is not None and folders_like(spark, f"{path}/{LISTING}"):
        files = _read_listed(spark, path, base)
    else:
        files = spark.read.text(path, wholetext=True)
        files = files.select("*", F.col("_metadata.file_name").alias("file_name"))
    keys = [c for c in files.columns if c not in ("value", "file_name")]
    text = F.regexp_replace("value", "\\n\\z", "") if ends_with_break else F.col("value")
    return files.select("file_name", text.alias("text"), *keys)
