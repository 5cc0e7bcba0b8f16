"""Centroid clustering over space-filling-curve zone maps.

Vectors are put in the order of a Hilbert curve, so that neighbours in that
order lie near each other, and packed into blocks that keep the least and the
greatest value of each component. A block's box bounds its distance to every
centroid from below and above: a centroid whose least distance is over the
smallest greatest one can be nearest to no vector of the block. With one
candidate left the whole block is assigned by its stored sum; otherwise its
vectors are compared with the candidates, all at once.

All values are integers, so results do not depend on the order of tasks: sums
are exact, distances are compared as whole numbers, ties go to the smaller
centroid. A round sends k x dims numbers to the driver and to the tasks.

Cases: null vectors, vectors of another length, with null or non-finite
components, or with a component beyond ``MOST`` after scaling (squared distances
would leave the range of a long) take no part and have no row; a null vec_id
takes part but never starts a centroid before one with a vec_id; repeated rows
count as vectors each; with fewer vectors than k there are as many centroids;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsift.llm.scratch import stored

DIMS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
MOST = 1 << 27  # 64 squares of twice this fit a long
CURVE_BITS = 3  # per component
BLOCK_ROWS = 256
_LONG = (1 << 63) - 1
_EXACT = 1 << 53  # whole numbers up to this are exact as doubles


def _scaled(dims: int, scale: int):
    """Usable vectors as whole numbers, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch["embedding"]), dims), False))
            values = batch["embedding"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                whole = np.floor(scale * values.reshape(-1, dims))
                usable = (np.abs(whole) <= MOST).all(axis=1)
            data = whole[usable].astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].filter(pa.array(usable)), pa.array([v.tobytes() for v in data], pa.binary())],
                names=["vec_id", "data"],
            )

    return run


def _matrix(data: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _extent(dims: int):
    """Least and greatest value of each component over a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, _LONG), np.full(dims, -_LONG)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["data"], dims)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    return run


def curve_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places of cells (rows of coordinates of this many bits) on the Hilbert curve, as bytes in that order.

    Per bit, from the highest: where a coordinate has it the lower bits of the
    first are turned over, elsewhere they are swapped with the first one's. The
    result as a Gray code, its bits interleaved, is the place on the curve.
    """
    x = np.array(cells, np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        lower = (1 << bit) - 1
        for row in x:
            turned = (row >> bit & 1).astype(bool)
            swapped = np.where(turned, 0, (x[0] ^ row) & lower)
            x[0] ^= np.where(turned, lower, swapped)
            row ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flips
    spread = np.stack([x >> bit & 1 for bit in range(bits - 1, -1, -1)])  # bit, component, cell
    packed = np.packbits(spread.reshape(-1, x.shape[1]).astype(np.uint8), axis=0).T
    return [row.tobytes() for row in packed]


def _on_curve(low: np.ndarray, high: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = ((_matrix(batch["data"], len(low)) - low) << CURVE_BITS) // (high - low + 1)
                key = pa.array(curve_keys(cells, CURVE_BITS), pa.binary())
                yield pa.RecordBatch.from_arrays([key, batch["vec_id"], batch["data"]], names=["key", "vec_id", "data"])

    return run


def _packed(dims: int):
    """Blocks of vectors that follow each other on the curve, with their box and sum."""

    def block(ids: list, data: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(data), "<i4").reshape(-1, dims)
        kept = [b"".join(data), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), x.sum(axis=0, dtype=np.int64).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(data)], pa.int32()), pa.array([ids]), *(pa.array([v], pa.binary()) for v in kept)],
            names=["n", "vec_ids", "data", "low", "high", "total"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], []
        for batch in batches:
            ids += batch["vec_id"].to_pylist()
            data += batch["data"].to_pylist()
            while len(data) >= BLOCK_ROWS:
                yield block(ids[:BLOCK_ROWS], data[:BLOCK_ROWS])
                ids, data = ids[BLOCK_ROWS:], data[BLOCK_ROWS:]
        if data:
            yield block(ids, data)

    return run


def zone_blocks(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """Usable vectors (vec_id, data), and blocks of them in curve order; both stored."""
    kind = dict(vectors.dtypes)["vec_id"]
    usable = stored(
        vectors.select("vec_id", "embedding").mapInArrow(_scaled(dims, scale), f"vec_id {kind}, data binary"), "whole-vectors"
    )
    parts = usable.select("data").mapInArrow(_extent(dims), "dim int, low bigint, high bigint")
    extent = sorted(parts.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    low, high = (np.array([r[c] for r in extent], np.int64) for c in ("low", "high"))
    keyed = usable.mapInArrow(_on_curve(low, high), f"key binary, vec_id {kind}, data binary")
    # Equal vectors are told apart by their number, so that a group of copies is split.
    order = ("key", F.xxhash64("vec_id"), "vec_id")
    blocks = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "data").mapInArrow(
        _packed(dims), f"n int, vec_ids array<{kind}>, data binary, low binary, high binary, total binary"
    )
    return usable, stored(blocks, "zone-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, ascending."""
    under, over = low - centroids, centroids - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    most = int(max(np.abs(x).max(), np.abs(centroids).max()))
    if 4 * x.shape[1] * most * most < _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _boxes(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each block's place in the batch and its candidates."""
    for i in range(batch.num_rows):
        low, high = (np.frombuffer(batch[c][i].as_py(), "<i4").astype(np.int64) for c in ("low", "high"))
        yield i, candidates(low, high, centroids)


def _nearest(data: bytes, centroids: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a block, the nearest candidate of each, and the distance to it."""
    x = np.frombuffer(data, "<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
    away = distances(x, centroids[found])
    best = away.argmin(axis=1)
    return x, found[best], away[np.arange(len(x)), best]


def _summed(centroids: np.ndarray):
    """A task's sums: (cluster, component, total), the count as component -1."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for i, found in _boxes(batch, centroids):
                if len(found) == 1:
                    totals[found[0]] += np.frombuffer(batch["total"][i].as_py(), np.int64)
                    counts[found[0]] += batch["n"][i].as_py()
                    continue
                x, cluster, _ = _nearest(batch["data"][i].as_py(), centroids, found)
                for c in found:
                    own = cluster == c
                    totals[c] += x[own].sum(axis=0)
                    counts[c] += own.sum()
        some = np.flatnonzero(counts)
        rows = np.concatenate([totals[some], counts[some, None]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(some, dims + 1).astype(np.int32)),
                pa.array(np.tile(np.append(np.arange(dims), -1), len(some)).astype(np.int32)),
                pa.array(rows.reshape(-1)),
            ],
            names=["cluster", "dim", "total"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in _boxes(batch, centroids):
                _, cluster, away = _nearest(batch["data"][i].as_py(), centroids, found)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_ids"].slice(i, 1).flatten(), pa.array(cluster.astype(np.int32)), pa.array(away)],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def starts(usable: DataFrame, dims: int = DIMS, k: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors whose salted vec_id has the smallest hashes, in their order."""
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = usable.orderBy(named.asc_nulls_last(), "data").limit(k).collect()
    return np.stack([np.frombuffer(r["data"], "<i4").astype(np.int64) for r in rows]) if rows else np.zeros((0, dims), np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of their vectors; empty ones stay."""
    parts = blocks.mapInArrow(_summed(centroids), "cluster int, dim int, total bigint")
    totals = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in totals}
    new = centroids.copy()
    for (cluster, dim), total in found.items():
        if dim >= 0:
            new[cluster, dim] = total // found[cluster, -1]
    return new


def cluster_vectors(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable row of ``vectors``."""
    kind = dict(vectors.dtypes)["vec_id"]
    usable, blocks = zone_blocks(vectors, dims, scale)
    centroids = starts(usable, dims, k, salt)
    if not len(centroids):
        return usable.selectExpr(
            "vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
        )
    centroids = reduce(lambda found, _: moved(blocks, found), range(rounds), centroids)
    rows = stored(blocks.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    sums = {
        r["cluster"]: int(r["total"])
        for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, min(total, _LONG), min(sum(sums.values()), _LONG), names[c]) for c, total in sums.items()]
    ends = rows.sparkSession.createDataFrame(told, "_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # At most k rows.
    return rows.join(F.broadcast(ends), F.col("cluster") == F.col("_cluster")).drop("_cluster")
