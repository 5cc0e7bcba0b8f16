"""The table of keys seen so far, in buckets and folded from time to time.

A run writes its new keys below ``delta/job=J/run_id=R/bucket=B``. When a few runs
have come together they are folded into ``base/gen=G/bucket=B``, one file per
bucket, and a list of the runs that are in it is written last; so a fold that
dies half-way is not seen, and a run is read either from the base or from its
own delta, never from both. The number of files a run reads depends on the
buckets its keys fall into and on ``fold_after``, not on the number of runs before.

A run that is repeated finds its own keys unseen, also if they were folded: the
base is then written anew without them. Folding and writing is done by one job
at a time; readers may be many. What a fold replaces is kept until the next
fold, for readers that have begun.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.operators.dedup import unseen
from feedsift.session import delete_folder, folders_like
from feedsift.streaming.tables import Run, is_finished, read_table, write_run

_RUN_COLUMNS = "job STRING, run_id BIGINT"


def _any_of(runs: list[Run]) -> Column:
    return reduce(lambda a, b: a | b, [run.own() for run in runs], F.lit(False))


@dataclass(frozen=True)
class SeenTable:
    """``schema`` names the columns of a row beside its bucket, job and run.

    ``runs``: folder of a table of finished runs; a run that is not in it is not
    seen. Without one every run counts once it is written.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str = "listing_key"
    runs: str | None = None
    buckets: int = 32
    fold_after: int = 8

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _generation(self) -> int:
        """Number of the latest base, 0 without one. The list of its runs is one file, so it is there whole or not at all."""
        lists = folders_like(self.spark, f"{self.path}/folded/gen=*/part-*")
        return max((int(name.split("/gen=")[-1].split("/")[0]) for name in lists), default=0)

    def folded(self, gen: int) -> DataFrame:
        """Runs in the base."""
        lists = read_table(self.spark, f"{self.path}/folded/gen={gen}", _RUN_COLUMNS) if gen else None
        return lists.where(F.col("job").isNotNull()) if gen else self.spark.createDataFrame([], _RUN_COLUMNS)

    def _state(self, run: Run | None = None) -> tuple[int, list[Run], bool]:
        """The latest base, the finished runs outside it but for ``run``, and whether ``run`` is in it.

        There are at most ``fold_after`` such runs, and those of another job at work.
        """
        gen, found = self._generation(), []
        for folder in folders_like(self.spark, f"{self.path}/delta/job=*/run_id=*"):
            job, number = folder.rstrip("/").split("/")[-2:]
            found.append(Run(job.removeprefix("job="), int(number.removeprefix("run_id="))))
        found = [r for r in found if r != run and (not self.runs or is_finished(self.spark, self.runs, r))]
        asked = [*found, run] if run else found
        inside = self.folded(gen).where(_any_of(asked)).collect() if gen and asked else []
        inside = {(r["job"], r["run_id"]) for r in inside}
        return gen, [r for r in found if (r.job, r.number) not in inside], bool(run) and (run.job, run.number) in inside

    def _rows(self, gen: int, runs: list[Run]) -> DataFrame:
        columns = f"{self.schema}, {_RUN_COLUMNS}, bucket INT"
        base = read_table(self.spark, f"{self.path}/base/gen={gen}", columns)
        return base.unionByName(read_table(self.spark, f"{self.path}/delta", columns).where(_any_of(runs)))

    def rows(self, buckets: list[int] | None = None, but: Run | None = None) -> DataFrame:
        """Rows of all finished runs, of some buckets only if these are named, without those of ``but``."""
        gen, pending, _ = self._state(but)
        found = self._rows(gen, pending)
        if buckets is not None:
            found = found.where(F.col("bucket").isin(buckets))
        return (found.where(~but.own()) if but else found).drop("bucket")

    def begin(self, run: Run) -> None:
        """To be called before a run reads: folds what has come together, and takes a repeated run's keys out of the base."""
        gen, pending, repeated = self._state(run)
        if repeated or (gen > 0) + len(pending) >= self.fold_after:
            self._fold(gen, pending, run)

    def _fold(self, gen: int, pending: list[Run], run: Run) -> None:
        rows = self._rows(gen, pending).where(~run.own())
        # Buckets are hashes of keys, so they are even; a task writes the one file of a bucket.
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/gen={gen + 1}")
        added = self.spark.createDataFrame([(r.job, r.number) for r in pending] + [(None, None)], _RUN_COLUMNS)
        self.folded(gen).where(~run.own()).unionByName(added).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded/gen={gen + 1}")
        for old in (f"base/gen={gen - 1}", f"folded/gen={gen - 1}"):
            delete_folder(self.spark, f"{self.path}/{old}")
        for r in pending:
            delete_folder(self.spark, f"{self.path}/delta/job={r.job}/run_id={r.number}")

    def unseen(self, rows: DataFrame, run: Run) -> DataFrame:
        """Rows whose key no other run has recorded; ``rows`` should be stored, since their keys are read first.

        Only buckets that hold a key of ``rows`` are read, and of these the keys
        that ``rows`` holds are found first: where the run is small it is sent
        to the table, and the history stays in place.
        """
        hit = [r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]
        known = self.rows(hit, run).select(self.key)
        known = known.join(rows.select(self.key).distinct(), self.key, "left_semi")
        return unseen(rows, known, self.key)

    def record(self, rows: DataFrame, run: Run) -> None:
        """Write the keys of ``run``, in place of those an earlier try of it wrote."""
        placed = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        write_run(placed, f"{self.path}/delta", run, "bucket")
