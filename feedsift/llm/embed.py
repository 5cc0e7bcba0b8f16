"""Near-duplicate vectors by a subspace pigeonhole join.

Two vectors of length one have a cosine of c or more if their squared distance
is 2 - 2c or less. A rotation, which changes no distance, spreads a vector's
length over all coordinates; then they are cut into blocks. If the distance is
within its budget, at least one block is within its proportional part. So each
block is a range join of its own, on a grid over its first coordinates: a
vector is at home in one cell, and cells within reach of each other meet. There
a matrix product finds the pairs within the block's budget, and each is
verified on the whole vectors. A pair counts in the first block that finds it.

Equal vectors are one class and are compared once. Cells are cut into chunks,
stored once per block in the shared folder, as given. What is dealt out to tasks
is pairs of chunks by name; a task reads the two. So what lies on disk grows
with the vectors, and only the comparisons with their square. No cell is too
large for one task, and a task gives per vector a number of links and one edge
that keeps its component, never pairs. Rotated vectors are made anew from equal
bytes by equal steps, so all tasks agree which block finds a pair first.

In many dimensions a block within its budget is common, so the work stays
quadratic with a small factor; see the README.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers,
and rows without a vec_id, link with nothing; vectors of different dimension
never link; repeated rows count as vectors each; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsift.llm.components import components
from feedsift.llm.records import opened
from feedsift.llm.scratch import drop_at_exit, stored
from feedsift.session import shared_folder

LEAST_COSINE = 0.95
BLOCK_DIMS = 8
GRID_DIMS = 2
CHUNK = 16_384  # vectors of a cell that a task holds on either side
_ROWS = 256  # of a chunk compared at once, and rotated at once
_COLUMNS = 2048  # of the other chunk compared at once
_PAIRS = 1 << 15  # verified at once
_MEETINGS = 8  # pairs of chunks a task is given, as long as there are tasks for all cores
_CELL = "dims int, block int, cell string, x int, y int"


def budget(least: float) -> float:
    """Largest squared distance of linked vectors of length one, with room for rounding."""
    return (2 - 2 * least) * (1 + 1e-9) + 1e-12


def block_edges(dims: int) -> list[int]:
    """Where the blocks of a vector begin, and the end."""
    n = max(1, round(dims / BLOCK_DIMS))
    return [dims * i // n for i in range(n + 1)]


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed rotation (or reflection) of this many dimensions."""
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all zero, at length one."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _unit(values: list | None) -> np.ndarray | None:
    if not values or None in values:
        return None
    row = np.array([values], np.float64)
    most = np.abs(row).max()
    return _units(row)[0] if np.isfinite(most) and most > 0 else None


def _turned(rows: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; always as many at once, so that a row's bytes do not depend on its neighbours."""
    units = _units(rows.astype(np.float64))
    turn = rotation(units.shape[1])
    found = np.empty_like(units)
    for at in range(0, len(units), _ROWS):
        part = units[at:at + _ROWS]
        full = np.zeros((_ROWS, units.shape[1]))
        full[:len(part)] = part
        found[at:at + _ROWS] = (full @ turn)[:len(part)]
    return found


def _usable(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length: the places of usable vectors and their components."""
    lists = vectors.cast(pa.list_(pa.float64()), safe=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)  # a null is NaN here
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        rows = values[starts[at][:, None] + np.arange(n)]
        most = np.abs(rows).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        yield n, at[good], rows[good]


def _keyed(kind: str | None):
    """A key of each usable vector; with ``kind`` also its dimensions and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keys, dims, vectors = ([None] * part.num_rows for _ in range(3))
                for n, at, rows in _usable(part["embedding"]):
                    # Division rounds alike everywhere, so a second pass finds the same keys.
                    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
                    raw = rows.astype(kind) if kind else None
                    for i, place in enumerate(at.tolist()):
                        keys[place], dims[place] = blake2b(scaled[i].tobytes(), digest_size=16).digest(), n
                        vectors[place] = raw[i].tobytes() if kind else None
                found = {"vec_id": part["vec_id"], "key": pa.array(keys, pa.binary())}
                if kind:
                    found |= {"dims": pa.array(dims, pa.int32()), "vector": pa.array(vectors, pa.binary())}
                yield pa.RecordBatch.from_pydict(found)

    return run


def reach(least: float, dims: int) -> float:
    """How far linked vectors are apart at most on a coordinate of a block that finds them; the blocks' lengths may differ by one."""
    edges = block_edges(dims)
    return float(np.sqrt(budget(least) * max(np.diff(edges)) / dims))


def _cells(least: float, kind: str, whole: bool):
    """Rows of classes for each block, with the cell they are at home in; not ``whole``: the cells alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                lengths = part["dims"].to_numpy()
                raw = part["vector"].to_pylist()
                for n in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == n)
                    turned = _turned(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, n))
                    edges, width = block_edges(n), 2 * reach(least, n)
                    for b, low in enumerate(edges[:-1]):
                        home = np.zeros((len(at), GRID_DIMS), np.int32)
                        own = turned[:, low:min(low + GRID_DIMS, edges[b + 1])]
                        home[:, :own.shape[1]] = np.floor(own / width)
                        x, y = home.T.tolist()
                        found = {
                            "dims": pa.array([n] * len(at), pa.int32()), "block": pa.array([b] * len(at), pa.int32()),
                            "cell": pa.array([f"{i}:{j}" for i, j in zip(x, y, strict=True)], pa.string()),
                            "x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32()),
                        }
                        if whole:
                            found |= {c: part[c].take(pa.array(at)) for c in ("key", "size", "vector")}
                        yield pa.RecordBatch.from_pydict(found)

    return run


def _written(folder: str):
    """A chunk as a file; a task that is repeated writes a file of another name."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.chunk"
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(np.int64(len(group)).tobytes())
            out.write(b"".join(group["key"]))
            out.write(group["size"].to_numpy(np.int64).tobytes())
            out.write(b"".join(group["vector"]))
        return group[["dims", "block", "cell", "x", "y", "i"]].head(1).assign(file=name)

    return run


def _read(folder: str, kind: str, file: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, class sizes and rotated vectors of a chunk."""
    system, base = opened(folder)
    with system.open_input_stream(f"{base}/{file}") as source:
        data = source.read()
    n = int(np.frombuffer(data, np.int64, 1)[0])
    keys = np.frombuffer(data, "V16", n, 8)
    sizes = np.frombuffer(data, np.int64, n, 8 + 16 * n)
    return keys, sizes, _turned(np.frombuffer(data, kind, n * dims, 8 + 24 * n).reshape(n, dims))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _near(left: np.ndarray, right: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose squared distance is ``most`` or a little more."""
    def norms(rows: np.ndarray) -> np.ndarray:
        return (rows * rows).sum(axis=1, keepdims=True)

    a = np.hstack([-2 * left, norms(left), np.ones((len(left), 1))]).astype(np.float32)
    b = np.hstack([right, np.ones((len(right), 1)), norms(right)]).astype(np.float32).T
    for i in range(0, len(left), _ROWS):
        for j in range(0, len(right), _COLUMNS):
            part = a[i:i + _ROWS] @ np.ascontiguousarray(b[:, j:j + _COLUMNS]) <= most + 1e-5
            found = np.flatnonzero(part)
            if len(found):
                yield i + found // part.shape[1], j + found % part.shape[1]


def _compared(left, right, block: int, least: float, within_one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links between two chunks, or within one: per vector how many others, and its component's first vector."""
    dims = left[2].shape[1]
    edges = block_edges(dims)
    parts = [budget(least) * (b - a) / dims for a, b in zip(edges, edges[1:], strict=False)]
    far = np.sqrt(parts[block]) + 1e-6
    low, high = edges[block], edges[block + 1]
    x, y = left[2], right[2]

    def close(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Rows that are near enough to the box of the others."""
        own, box = rows[:, low:high], others[:, low:high]
        return np.flatnonzero(((own >= box.min(axis=0) - far) & (own <= box.max(axis=0) + far)).all(axis=1))

    mine = np.arange(len(x)) if within_one else close(x, y)
    theirs = mine if within_one else close(y, x)
    keys = left[0] if within_one else np.concatenate([left[0], right[0]])
    size = left[1] if within_one else np.concatenate([left[1], right[1]])
    shift = 0 if within_one else len(x)
    counts = np.zeros(len(keys), np.int64)
    found_a, found_b = [], []
    for i, j in _near(x[mine, low:high], y[theirs, low:high], parts[block]):
        i, j = mine[i], theirs[j]
        if within_one:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), _PAIRS):
            a, b = i[k:k + _PAIRS], j[k:k + _PAIRS]
            p, q = x[a], y[b]
            gaps = (p - q) ** 2
            within = np.stack([gaps[:, m:n].sum(axis=1) <= part for m, n, part in zip(edges, edges[1:], parts, strict=False)], axis=1)
            linked = (within.argmax(axis=1) == block) & within[:, block] & ((p * q).sum(axis=1) >= least)
            a, b = a[linked], b[linked] + shift
            np.add.at(counts, a, size[b])
            np.add.at(counts, b, size[a])
            found_a.append(a)
            found_b.append(b)
    if not counts.any():
        return None
    root = _local_roots(len(keys), np.concatenate(found_a), np.concatenate(found_b))
    some = np.flatnonzero(counts)
    return keys[some], counts[some], keys[root[some]]


def _linked(folder: str, kind: str, least: float):
    """Links of each pair of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = lru_cache(maxsize=2)(lambda file, dims: _read(folder, kind, file, dims))
        for batch in batches:
            for r in batch.to_pylist():
                left = kept(r["file"], r["dims"])
                right = kept(r["other"], r["dims"])
                found = _compared(left, right, r["block"], least, r["file"] == r["other"])
                if found:
                    keys, counts, roots = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(counts, pa.int64()),
                         pa.array([k.tobytes() for k in roots], pa.binary())],
                        names=["key", "links", "with"],
                    )

    return run


def _chunks(classes: DataFrame, least: float, kind: str, folder: str) -> DataFrame:
    """The chunks of each block's cells, written to ``folder``: dims, block, cell, x, y, i, file."""
    by = ["dims", "block", "cell"]
    sizes = stored(
        classes.mapInArrow(_cells(least, kind, False), _CELL).groupBy(*by).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")),
        "cell-sizes",
    ).withColumnsRenamed({c: f"_{c}" for c in by})
    rows = classes.mapInArrow(_cells(least, kind, True), f"{_CELL}, key binary, size bigint, vector binary")
    dealt = rows.join(sizes, [F.col(c) == F.col(f"_{c}") for c in by]).withColumn("i", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    return stored(
        dealt.select("dims", "block", "cell", "x", "y", "i", "key", "size", "vector").groupBy(*by, "i").applyInPandas(
            _written(folder), f"{_CELL}, i int, file string"
        ),
        "chunks",
    )


def _meetings(chunks: DataFrame) -> DataFrame:
    """Pairs of chunks of one cell, or of cells within reach of each other, once."""
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    left = chunks.select("*", F.explode(steps).alias("to"))
    right = chunks.select(
        F.col("dims").alias("_dims"), F.col("block").alias("_block"), F.col("x").alias("_x"), F.col("y").alias("_y"),
        F.col("i").alias("j"), F.col("file").alias("other"),
    )
    met = (
        (F.col("dims") == F.col("_dims")) & (F.col("block") == F.col("_block"))
        & (F.col("x") + F.col("to.x") == F.col("_x")) & (F.col("y") + F.col("to.y") == F.col("_y"))
    )
    own = (F.col("to.x") == 0) & (F.col("to.y") == 0)
    return left.join(right, met).where(~own | (F.col("i") <= F.col("j"))).select("dims", "block", "cell", "i", "j", "file", "other")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding)."""
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    vectors = vectors.select("vec_id", "embedding")
    kind = "<f4" if kinds["embedding"] == "array<float>" else "<f8"
    id_kind = kinds["vec_id"]
    usable = vectors.mapInArrow(_keyed(kind), f"vec_id {id_kind}, key binary, dims int, vector binary").filter(
        F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    )
    classes = stored(
        usable.groupBy("key").agg(
            F.min("vec_id").alias("low"), F.count("*").alias("size"), F.first("dims").alias("dims"), F.first("vector").alias("vector")
        ),
        "vector-classes",
    )
    folder = shared_folder(spark, "vector-chunks")
    drop_at_exit(spark, folder)
    met = stored(_meetings(_chunks(classes.select("key", "size", "dims", "vector"), least, kind, folder)), "chunk-pairs")
    tasks = max(2 * spark.sparkContext.defaultParallelism, met.count() // _MEETINGS)
    found = stored(
        # Dealt out by chunk pair: rows that are dealt out by cell would not move, and a cell's pairs share a task.
        met.repartition(tasks, "dims", "block", "cell", "i", "j").sortWithinPartitions("file").mapInArrow(
            _linked(folder, kind, least), "key binary, links bigint, with binary"
        ),
        "vector-links",
    )
    labels = components(found.select(F.col("key").alias("a"), F.col("with").alias("b")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links")).withColumnRenamed("key", "_key")
    rooted = stored(
        classes.join(labels, F.col("key") == F.col("node"), "left")
        .join(counts, F.col("key") == F.col("_key"), "left")
        .select(
            "key", F.coalesce("root", "key").alias("root"), "low",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "rooted",
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "_root")
    to = rooted.join(lows, F.col("root") == F.col("_root")).select(
        F.col("key").alias("_key"), "n_links", F.col("component_id").alias("_component")
    )
    usable_id = F.when(F.col("vec_id").isNotNull(), F.col("key"))
    component = F.coalesce("_component", "vec_id")
    named = vectors.mapInArrow(_keyed(None), f"vec_id {id_kind}, key binary")
    return named.join(to, usable_id == F.col("_key"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
