"""Hard-negative mining by angular triangle filtering.

Every vector keeps its angles to a few reference directions. Angles obey the
triangle inequality: that between an anchor and a vector lies between the
difference and the sum of their angles to any reference. So stored angles give
an interval of the cosine, and with the norms one of the inner product, widened
against rounding. Vectors lie in blocks of one label, ordered by the nearest
reference and the angle to it, so a block is a window of angles; only where a
block's interval overlaps the scores still asked for are the inner products
formed, as whole numbers.

Two passes per chunk of anchors: the first finds each anchor's best vectors of
its own label (asked for: what beats the best so far), the second, per anchor
and positive, the best of other labels with a score in the positive's window. A
task hands on its own best few per anchor and window, so what is shuffled does
not depend on how many vectors score alike.

Anchors are a stated query set (ids divisible by ``EVERY``). They are sent to the
tasks in chunks of at most ``ANCHORS`` rows and ``ANCHOR_BYTES``, one chunk after another, so the
vectors stay where they are, however many anchors there are.

Cases: rows without a vec_id, with a null label, a null or empty vector, null or
non-finite components, or a norm of over 2**29 after scaling (scores would leave
the range of a long) take no part; vectors of different length never meet; zero vectors score 0;
rows with the anchor's vec_id are never its positives; repeated rows count each,
also as anchors; an anchor without positives, or a positive without negatives,
has no rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedsift.llm.scratch import drop_at_exit, stored
from feedsift.session import shared_folder

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
LEAST_PERCENT, MOST_PERCENT = 80, 100
REFERENCES = 16  # per vector length
BLOCK_ROWS = 256
ANCHORS, ANCHOR_BYTES = 8192, 16 << 20
_AT_ONCE = 1024  # anchors scored together with a block
_LARGEST = 1 << 29  # norm; 100 times a product of two stays below 2**65, compared in units of 20 it fits
_EXACT = 1 << 53
_SLACK = 1e-6  # radians, far over the error of an angle
_NONE = np.iinfo(np.int64).min


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as whole numbers of 64 bits, with length and norm."""
    for batch in batches:
        ids, labels, dims, norms, data = [], [], [], [], []
        lists = batch["embedding"].cast(pa.list_(pa.float64()))
        for i in range(batch.num_rows):
            values = lists[i].values
            if values is None or len(values) == 0 or values.null_count:
                continue
            with np.errstate(all="ignore"):
                x = np.floor(SCALE * values.to_numpy())
                norm = np.sqrt(x @ x)
            if norm <= _LARGEST:  # also false for what is not finite
                ids.append(batch["vec_id"][i].as_py())
                labels.append(batch["label"][i].as_py())
                dims.append(len(x))
                norms.append(norm)
                data.append(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()),
             pa.array(data, pa.binary())],
            names=["vec_id", "label", "dims", "norm", "data"],
        )


def _angled(references: dict[int, np.ndarray]):
    """Rows with their angles to the references of their length, and the nearest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles, near, least = [], [], []
            for dims, norm, data in zip(*(batch[c].to_pylist() for c in ("dims", "norm", "data")), strict=True):
                unit = np.frombuffer(data, "<i8") / norm if norm else np.zeros(dims)
                own = np.arccos(np.clip(references[dims] @ unit, -1, 1)) if dims in references else np.zeros(0)
                angles.append(own.tobytes())
                near.append(int(own.argmin()) if len(own) else 0)
                least.append(float(own.min()) if len(own) else 0.0)
            more = [pa.array(angles, pa.binary()), pa.array(near, pa.int32()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "angles", "near", "least"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length and label that follow each other in angle."""

    def block(key: tuple, rows: list[dict]) -> pa.RecordBatch:
        angles = np.stack([np.frombuffer(r["angles"]) for r in rows])
        norms = [r["norm"] for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([[r["vec_id"] for r in rows]]),
                pa.array([b"".join(r["data"] for r in rows)], pa.binary()), pa.array([min(norms)]), pa.array([max(norms)]),
                pa.array([angles.min(axis=0).tobytes()], pa.binary()), pa.array([angles.max(axis=0).tobytes()], pa.binary()),
            ],
            names=["dims", "label", "vec_ids", "data", "norm_low", "norm_high", "angle_low", "angle_high"],
        )

    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["dims"], row["label"])
            if rows and (own != key or len(rows) == BLOCK_ROWS):
                yield block(key, rows)
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield block(key, rows)


@dataclass(frozen=True)
class Anchors:
    """A chunk of anchors of one length; ``scores`` and ``ids`` of its positives once they are known."""

    ids: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    vectors: np.ndarray
    angles: np.ndarray
    scores: np.ndarray | None = None
    positives: np.ndarray | None = None


def bounds(anchors: Anchors, block: dict, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that any row of the block can have with each anchor of ``at``."""
    own, low, high = anchors.angles[at], np.frombuffer(block["angle_low"]), np.frombuffer(block["angle_high"])
    apart = np.maximum(np.maximum(low - own, own - high), 0).max(axis=1, initial=0)
    round_ = np.minimum(own + high, 2 * np.pi - own - low).min(axis=1, initial=np.pi)
    near = np.cos(np.clip(apart - _SLACK, 0, np.pi))
    far = np.cos(np.clip(round_ + _SLACK, 0, np.pi))
    norm = anchors.norms[at]
    slack = 1 + 1e-9 * norm * block["norm_high"]
    most = norm * np.where(near >= 0, near * block["norm_high"], near * block["norm_low"]) + slack
    least = norm * np.where(far >= 0, far * block["norm_low"], far * block["norm_high"]) - slack
    return least, most


def _products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; ``largest`` bounds them."""
    if largest < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Best:
    """The best ``keep`` (score, id) of each slot; ties go to the smaller id."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.least = keep, np.full(slots, _NONE)
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - first
        kept = place < self.keep
        full = place == self.keep - 1
        self.least[slot[full]] = score[full]
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]


def _scored(chunks: list[Anchors], batches: Iterator[pa.RecordBatch], wanted, best: dict[int, _Best], place) -> None:
    """Go through blocks; ``wanted`` gives a chunk's anchors for a block and the range of scores still asked for."""
    for batch in batches:
        for block in batch.to_pylist():
            for n, anchors in enumerate(chunks):
                if anchors.vectors.shape[1] != block["dims"]:
                    continue
                ids = np.array(block["vec_ids"], np.int64)
                rows = np.frombuffer(block["data"], "<i8").reshape(len(ids), -1)
                at, low, high = wanted(anchors, block, best[n])
                least, most = bounds(anchors, block, at)
                overlap = (most >= low) & (least <= high)
                at, low = at[overlap], low[overlap]
                for k in range(0, len(at), _AT_ONCE):
                    some = at[k:k + _AT_ONCE]
                    found = _products(anchors.vectors[some], rows, float(anchors.norms[some].max()) * block["norm_high"])
                    i, j = np.nonzero(found >= low[k:k + _AT_ONCE, None])
                    place(anchors, best[n], some[i], found[i, j], ids[j])


def _told(best: dict[int, _Best]) -> Iterator[pa.RecordBatch]:
    for n, found in best.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found.slot), n, np.int32)), pa.array(found.slot), pa.array(found.score), pa.array(found.id)],
            names=["chunk", "slot", "score", "vec_id"],
        )


_FOUND = "chunk int, slot bigint, score bigint, vec_id bigint"


def _positives(sent, keep: int):
    """A task's best rows of each anchor's own label; the slot is the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = sent.value
        best = {n: _Best(len(c.ids), keep) for n, c in enumerate(chunks)}

        def wanted(anchors, block, found):
            at = np.flatnonzero(anchors.labels == block["label"])
            return at, found.least[at], np.full(len(at), np.inf)

        def place(anchors, found, slot, score, ids):
            other = anchors.ids[slot] != ids
            found.add(slot[other], score[other], ids[other])

        _scored(chunks, batches, wanted, best, place)
        yield from _told(best)

    return run


def _negatives(sent, positives: int, keep: int, least_percent: int, most_percent: int):
    """A task's best rows of other labels in each window; the slot is anchor and positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = sent.value
        best = {n: _Best(len(c.ids) * positives, keep) for n, c in enumerate(chunks)}
        # Windows in whole numbers: from the ceiling of the lower end to the floor of the upper one.
        ends = [(-((-least_percent * c.scores) // 100), (most_percent * c.scores) // 100) for c in chunks]
        by_anchor = {id(c): e for c, e in zip(chunks, ends, strict=True)}

        def wanted(anchors, block, found):
            at = np.flatnonzero((anchors.labels != block["label"]) & (anchors.scores > _NONE).any(axis=1))
            low, high = (e[at] for e in by_anchor[id(anchors)])
            asked = np.maximum(low, found.least.reshape(-1, positives)[at])
            open_ = (anchors.scores[at] > _NONE) & (asked <= high)
            low = np.where(open_, asked, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            high = np.where(open_, high, _NONE).max(axis=1, initial=_NONE)
            some = open_.any(axis=1)
            return at[some], low[some], high[some]

        def place(anchors, found, at, score, ids):
            low, high = by_anchor[id(anchors)]
            for p in range(positives):
                slot = at * positives + p
                own = (anchors.scores[at, p] > _NONE) & (score >= low[at, p]) & (score <= high[at, p]) & (score >= found.least[slot])
                found.add(slot[own], score[own], ids[own])

        _scored(chunks, batches, wanted, best, place)
        yield from _told(best)

    return run


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` of each slot over all tasks, with ``rank`` from 1."""
    order = Window.partitionBy("chunk", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _references(rows: DataFrame) -> dict[int, np.ndarray]:
    """Directions of a few rows per vector length, those with the smallest hash of their vec_id."""
    order = Window.partitionBy("dims").orderBy(F.xxhash64("vec_id"), "vec_id", "data")
    picked = rows.filter("norm > 0").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= REFERENCES)
    found = defaultdict(list)
    for r in picked.select("dims", "norm", "data").collect():
        found[r["dims"]].append(np.frombuffer(r["data"], "<i8") / r["norm"])
    return {dims: np.stack(units) for dims, units in found.items()}


def _chunks(anchors: DataFrame) -> Iterator[list[Anchors]]:
    """Anchors in chunks of bounded size, each as one part per vector length."""

    def made(rows: list) -> list[Anchors]:
        parts = defaultdict(list)
        for r in rows:
            parts[r["dims"]].append(r)
        return [
            Anchors(
                np.array([r["vec_id"] for r in part], np.int64), np.array([r["label"] for r in part], np.int64),
                np.array([r["norm"] for r in part]), np.stack([np.frombuffer(r["data"], "<i8") for r in part]),
                np.stack([np.frombuffer(r["angles"]) for r in part]),
            )
            for part in parts.values()
        ]

    rows, size = [], 0
    for row in anchors.toLocalIterator():
        rows.append(row)
        size += len(row["data"])
        if len(rows) == ANCHORS or size >= ANCHOR_BYTES:
            yield made(rows)
            rows, size = [], 0
    if rows:
        yield made(rows)


def _mined(spark: SparkSession, blocks: DataFrame, chunks: list[Anchors], percents: tuple[int, int], keep: tuple[int, int]) -> DataFrame:
    """Negatives of a chunk of anchors."""
    positives, negatives = keep
    sent = spark.sparkContext.broadcast(chunks)
    best = _first(blocks.mapInArrow(_positives(sent, positives), _FOUND), positives).collect()
    scores = [np.full((len(c.ids), positives), _NONE) for c in chunks]
    ids = [np.zeros((len(c.ids), positives), np.int64) for c in chunks]
    for r in best:
        scores[r["chunk"]][r["slot"], r["rank"] - 1] = r["score"]
        ids[r["chunk"]][r["slot"], r["rank"] - 1] = r["vec_id"]
    told = [
        Anchors(c.ids, c.labels, c.norms, c.vectors, c.angles, s, i) for c, s, i in zip(chunks, scores, ids, strict=True)
    ]
    known = spark.sparkContext.broadcast(told)
    found = _first(blocks.mapInArrow(_negatives(known, positives, negatives, *percents), _FOUND), negatives)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, slot = (batch[c].to_numpy() for c in ("chunk", "slot"))
            columns = [np.zeros(len(slot), np.int64) for _ in range(3)]
            for n, c in enumerate(known.value):
                own = chunk == n
                a, p = slot[own] // positives, slot[own] % positives
                for column, values in zip(columns, (c.ids[a], c.positives[a, p], c.scores[a, p]), strict=True):
                    column[own] = values
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns[:2]), batch["rank"], batch["vec_id"], pa.array(columns[2]), batch["score"]],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return found.mapInArrow(named, RESULT)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def whole_vectors(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Usable rows of ``vectors`` (vec_id, embedding) as whole numbers; ``label`` is an expression."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.expr(label).cast("bigint").alias("label"), "embedding")
    usable = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return usable.mapInArrow(_whole, "vec_id bigint, label bigint, dims int, norm double, data binary")


def hard_negatives(
    vectors: DataFrame, label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percents: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for anchors with a vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, label), "scaled-vectors")
    angled = rows.mapInArrow(
        _angled(_references(rows)),
        "vec_id bigint, label bigint, dims int, norm double, data binary, angles binary, near int, least double",
    )
    # The hash splits a group of copies, which share all that stands before it.
    order = ("dims", "label", "near", "least", F.xxhash64("vec_id"))
    blocks = stored(
        angled.repartitionByRange(*order).sortWithinPartitions(*order, "vec_id").mapInArrow(
            _packed,
            "dims int, label bigint, vec_ids array<bigint>, data binary, norm_low double, norm_high double, "
            "angle_low binary, angle_high binary",
        ),
        "angle-blocks",
    )
    anchors = stored(angled.filter(F.col("vec_id") % every == 0), "anchors")
    path = shared_folder(spark, "hard-negatives")
    drop_at_exit(spark, path)
    spark.createDataFrame([], RESULT).write.parquet(path)
    for chunk in _chunks(anchors):
        _mined(spark, blocks, chunk, percents, (positives, negatives)).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
