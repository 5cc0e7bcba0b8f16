"""Packing of token sequences: shortest pack first over the histogram of lengths.

A document is cut every ``size`` ids; full pieces fill a sequence each. What
remains is counted by length. Lengths are placed longest first, each into the
pack that is filled least and still has room, for as many packs at once as
there are. A pack is opened only where none has room, and takes a length as
often as it fits, so copies share packs; packs with the same content are one
pattern with a count. Then a
pattern's slots are handed to documents by their rank among those of that
length. The histogram has ``size`` - 1 lengths at most, so only it, and never
a row of a document, reaches the driver; patterns are few for the same reason.

Cases: a null or empty text has just the end id; null ids and repeated rows
are packed like others; an empty table packs to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedsift.llm.batches import arrow_map
from feedsift.llm.scratch import stored, text_key
from feedsift.llm.tokens import text_ids

SIZE = 1024
# Ranks are counted within buckets of rows, then shifted by what lies before the bucket.
LEAST_BUCKETS = 256
BUCKET_ROWS = 200_000

Slot = tuple[int, int, int, int]  # length, first rank, first sequence, offset


def packed_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with their counts."""
    by_room: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = size
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                packs, count, pattern = None, -(-left // (size // length)), ()  # equal lengths share packs
                room = size
            else:
                packs = by_room[room]
                pattern, there = next(iter(packs.items()))
                count = min(left, there)
                if count == there:
                    del packs[pattern]
                else:
                    packs[pattern] = there - count
            grown, rest = (*pattern, length), room - length
            by_room[rest][grown] = by_room[rest].get(grown, 0) + count
            left -= count
            if packs is None:
                room = rest
    return [x for packs in by_room for x in sorted(packs.items(), reverse=True)]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[Slot], int]:
    """Where the ranks of each length go, and the number of sequences."""
    used: dict[int, int] = {}
    found, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            found.append((length, rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return sorted(found), sequence


def token_pieces(docs: DataFrame, path: str, end_id: int, size: int, blanks_count: bool, ids: bool) -> DataFrame:
    """doc_id, text_key, doc_tokens and per piece its checksum (and its ids) of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tail = np.array([end_id], "<u4").tobytes()
        whole = [x + tail for x in text_ids(batch["text"], path, blanks_count)]
        cut = [[x[a:a + 4 * size] for a in range(0, len(x), 4 * size)] for x in whole]
        columns = {
            "doc_id": batch["doc_id"],
            "text_key": batch["text_key"],
            "doc_tokens": pa.array([len(x) // 4 for x in whole], pa.int64()),
            "crcs": pa.array([[zlib.crc32(p) for p in pieces] for pieces in cut], pa.list_(pa.int64())),
        }
        if ids:
            columns["ids"] = pa.array(cut, pa.list_(pa.binary()))
        return pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, text_key bigint, doc_tokens bigint, crcs array<bigint>" + ", ids array<binary>" * ids
    return arrow_map(docs.select("doc_id", text_key().alias("text_key"), "text"), work, schema)


def _placed(rows: DataFrame, places: list[Slot]) -> DataFrame:
    """Adds sequence and offset of each row's remainder (``rest``, ``rank``)."""
    table = np.array(places, np.int64).reshape(-1, 4)
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, rank = batch["rest"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, rest * (1 << 48) + rank, side="right") - 1
            has = rest > 0
            at = np.where(has, at, 0)
            pick = lambda k: table[at, k] if len(table) else np.zeros(len(rest), np.int64)
            sequence = pick(2) + rank - pick(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence, pa.int64(), mask=~has), pa.array(pick(3), pa.int64(), mask=~has)],
                names=[*batch.schema.names, "rest_sequence", "rest_offset"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", rest_sequence bigint, rest_offset bigint"
    return rows.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, blanks_count: bool = True, ids: bool = False
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places in sequences of ``size`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, if ``ids``, the piece's ids. Positions behind the last piece of a
    sequence are padding.
    """
    cut = stored(token_pieces(docs, path, end_id, size, blanks_count, ids), "pieces").withColumns({
        "rest": F.col("doc_tokens") % size,
        "full": F.floor(F.col("doc_tokens") / size),
    })
    counted = cut.groupBy("rest").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    patterns = packed_patterns({r["rest"]: r["n"] for r in counted if r["rest"]}, size)
    places, sequences = slots(patterns)
    buckets = max(LEAST_BUCKETS, sum(r["n"] for r in counted) // BUCKET_ROWS)

    order = [F.col("doc_id"), F.col("text_key")]
    in_bucket = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets))).withColumns({
        "full_before": F.coalesce(F.sum("full").over(in_bucket), F.lit(0)),
        "row": F.row_number().over(Window.partitionBy("bucket", "rest").orderBy(*order)) - 1,
    })
    sizes = cut.select("rest", "full", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)).alias("bucket"))
    earlier = lambda w: w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sizes.groupBy("rest", "bucket").agg(F.count("*").alias("n"))
        .select(
            F.col("rest").alias("_rest"), F.col("bucket").alias("_bucket"),
            F.coalesce(F.sum("n").over(earlier(Window.partitionBy("rest"))), F.lit(0)).alias("rank_base"),
        )
    )
    full = (
        sizes.groupBy("bucket").agg(F.sum("full").alias("n"))  # one row per bucket of many documents
        .select(
            F.col("bucket").alias("_full_bucket"),
            F.coalesce(F.sum("n").over(earlier(Window.partitionBy())), F.lit(0)).alias("full_base"),
        )
    )
    joined = (
        ranked.join(before, (F.col("rest") == F.col("_rest")) & (F.col("bucket") == F.col("_bucket")))
        .join(full, F.col("bucket") == F.col("_full_bucket"))
        .withColumns({"rank": F.col("rank_base") + F.col("row"), "full_first": F.col("full_base") + F.col("full_before")})
        .select("doc_id", "doc_tokens", "crcs", *["ids"] * ids, "rest", "full", "rank", "full_first")
    )
    pieces = _placed(joined, places).select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    whole = F.col("piece") < F.col("full")
    return pieces.select(
        "doc_id",
        (F.col("piece") * F.lit(size)).cast("bigint").alias("start"),
        F.when(whole, F.lit(size)).otherwise(F.col("rest")).cast("bigint").alias("length"),
        "ids_crc32", "doc_tokens",
        F.when(whole, F.lit(sequences) + F.col("full_first") + F.col("piece"))
        .otherwise(F.col("rest_sequence")).cast("bigint").alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("rest_offset")).cast("bigint").alias("offset"),
        *[F.col("ids")[F.col("piece")].alias("ids")] * ids,
    )
