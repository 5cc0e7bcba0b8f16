"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Rows up to which a table built on the driver is sent to every executor.
BROADCAST_ROWS = 10_000


def build_session(app_name: str = "feedsift", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and times in UTC."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder the cluster names.

    Only a local session, where every task runs on this machine, may go
    without that setting.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        base = delete_at_exit(spark, tempfile.mkdtemp(prefix="feedsift-"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder with scheme ``file``, which every executor reaches by that path; None for other schemes."""
    files, place = _file_system(spark, path)
    return files.makeQualified(place).toUri().getPath() if files.getScheme() == "file" else None


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, wherever it lies; nothing happens if there is none."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """Let the file system delete ``path`` when the driver ends."""
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    return path


def folders_like(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with ``*``."""
    files, place = _file_system(spark, pattern)
    return [str(found.getPath().toString()) for found in files.globStatus(place) or []]
