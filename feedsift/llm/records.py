"""Token ids as binary records with checksums, and a separate offset index.

A record is: length of the ids in bytes (unsigned 64-bit), masked CRC-32 of
these eight bytes, the ids, masked CRC-32 of the ids; all little-endian. An id
takes two bytes where the vocabulary allows it, else four. Masking turns the
checksum by 15 bits and adds a constant, so that a checksum of data that holds
checksums stays telling. Files hold documents in ascending doc_id order, each
file a range of ids; a row of the index names file, place and size of a record.

Cases: a null text is empty and yields only the end id; null ids come first;
repeated rows give a record each; an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedsift.llm.batches import sliced
from feedsift.llm.scratch import drop_at_exit, stored, text_key
from feedsift.llm.tokens import text_ids
from feedsift.session import shared_folder

# Fixed value: what masking adds.
MASK_DELTA = 0xA282EAD8
FILE_BYTES = 64 << 20
_FRAME = 16  # bytes of a record besides its ids

INDEX = "file string, number bigint, doc_id bigint, text_key bigint, offset bigint, n_bytes bigint, width int, n_tokens bigint, tokens_before bigint"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(ids: bytes) -> bytes:
    size = struct.pack("<Q", len(ids))
    return b"".join((size, struct.pack("<I", masked_crc(size)), ids, struct.pack("<I", masked_crc(ids))))


def unframed(record: bytes) -> bytes:
    """The ids of a record; raises where a checksum or the length is wrong."""
    size, check = struct.unpack_from("<QI", record)
    ids = record[12:12 + size]
    if masked_crc(record[:8]) != check or len(record) != size + _FRAME:
        raise ValueError("length of a record is damaged")
    if masked_crc(ids) != struct.unpack_from("<I", record, 12 + size)[0]:
        raise ValueError("ids of a record are damaged")
    return ids


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder named by URI or path, and the path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_records(docs: DataFrame, folder: str, path: str, end_id: int, blanks_count: bool) -> DataFrame:
    """Write the records of ``docs`` (doc_id, text); returns the stored index.

    A task names its files anew, and only files of tasks that ended are in the
    index, so a repeated task leaves nothing wrong behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        out, name, rows, at, before, number = None, "", [], 0, 0, 0

        def index() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in sliced(batches, "text"):
            made = text_ids(batch["text"], path, blanks_count)
            for doc_id, key, ids in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), made, strict=True):
                numbers = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                width = 2 if numbers.max() < 1 << 16 else 4
                record = framed(numbers.astype(f"<u{width}").tobytes())
                if out is not None and at + len(record) > FILE_BYTES:
                    out.close()
                    yield index()
                    out, rows = None, []
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.records", 0
                    out = system.open_output_stream(f"{base}/{name}")
                out.write(record)
                rows.append((name, number, doc_id, key, at, len(record), width, len(numbers), before))
                at, before, number = at + len(record), before + len(numbers), number + 1
        if out is not None:
            out.close()
            yield index()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text")
        .repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    )
    return stored(ordered.mapInArrow(run, INDEX).withColumn("part", F.spark_partition_id()), "record-index")


def starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all records before, in the order of the files."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the writer
    base = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    return index.join(base, F.col("part") == F.col("_part")).withColumn(
        "start", F.col("_base") + F.col("tokens_before")
    ).drop("_part", "_base")


def read_records(index: DataFrame, folder: str, columns: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``columns`` of the index and the ids read from the files, checked.

    Rows of the index may come in any order; those that lie side by side in a
    batch are read together.
    """
    kinds = dict(index.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        name, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256), []
                rows = zip(*(part[c].to_pylist() for c in ("file", "offset", "n_bytes", "width")), strict=True)
                for file, offset, n_bytes, width in rows:
                    if file != name:
                        name, source = file, system.open_input_file(f"{base}/{file}")
                    ids = unframed(source.read_at(n_bytes, offset))
                    found.append(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in columns), pa.array(found, pa.binary())], names=[*columns, "ids"]
                )

    return index.mapInArrow(run, schema)


def record_digests(docs: DataFrame, path: str, end_id: int = 1, blanks_count: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from files written and read back."""
    folder = shared_folder(docs.sparkSession, "records")
    drop_at_exit(docs.sparkSession, folder)
    index = starts(write_records(docs, folder, path, end_id, blanks_count))
    read = read_records(index, folder)
    return read.select(
        "doc_id", "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
