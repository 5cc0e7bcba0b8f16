"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed size. Equal blocks get one integer name:
all distinct blocks are sorted, and a block's name is its place. Then adjacent
names are paired, the pairs are sorted and named again, until one name is left
of each text. Since every name stands for one sequence of blocks and nothing
else, equal identities mean equal texts: no hash decides.

Texts cross the network once. The task that cuts texts gives each distinct
block a number of its own and sends the block's bytes with it a single time;
later only numbers are joined, on (task, number), so that a block which a third
of all texts hold makes no large task. A task remembers blocks up to
``KNOWN_BYTES``; a block met again after that is sent again and gets the same name.

Texts are compared without the bytes 0x20 and 0x09-0x0D. Of equal texts the row
with the most code points stays, then the one with the smallest doc_id (rows
without a doc_id come last), then the first one read.

Cases: a null text is an empty one; empty texts and texts of separators alone
equal each other; repeated rows are copies of which one stays; a text of any
length is cut into blocks in one task and compared as rows of numbers; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsift.llm.batches import SEPARATORS, sliced
from feedsift.llm.scratch import stored

BLOCK_BYTES = 2048
KNOWN_BYTES = 64 << 20
NO_NAME = -1  # in place of the second name of a last, single one
_TASK_BITS = 40  # of a name, for the place within a task


def _blocks(kind: pa.DataType):
    """One row per block of each text; a block's bytes where the task has not sent them yet.

    The row of a text's first block carries what belongs to the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known: dict[bytes, int] = {}
        held = n_texts = n_numbers = 0
        for part in sliced(batches, "text"):
            whose, place, count, number, sent, digest = [], [], [], [], [], []
            for row, text in enumerate(part["text"].cast(pa.binary()).to_pylist()):
                left = (text or b"").translate(None, SEPARATORS)
                n = max(1, -(-len(left) // BLOCK_BYTES))
                for pos in range(n):
                    block = left[pos * BLOCK_BYTES:(pos + 1) * BLOCK_BYTES]
                    ref = known.get(block)
                    fresh = ref is None
                    if fresh:
                        if held > KNOWN_BYTES:
                            known, held = {}, 0
                        ref = known[block] = n_numbers
                        n_numbers += 1
                        held += len(block) + 100
                    whose.append(row)
                    place.append(pos)
                    count.append(n)
                    number.append(ref)
                    sent.append(block if fresh else None)
                    digest.append(sha256(left).hexdigest() if pos == 0 else None)
            rows, places = np.array(whose, np.int64), np.array(place, np.int32)
            first = pa.array(np.where(places == 0, rows, -1), pa.int64())
            own = pc.if_else(pc.less(first, 0), pa.scalar(None, pa.int64()), first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), task, np.int32)), pa.array(rows + n_texts), pa.array(places),
                    pa.array(count, pa.int32()), pa.array(number, pa.int64()), pa.array(sent, pa.binary()),
                    part["doc_id"].take(own).cast(kind), part["n_points"].take(own), pa.array(digest, pa.string()),
                ],
                names=["task", "text_no", "pos", "n_blocks", "ref", "block", "doc_id", "n_points", "text_sha256"],
            )
            n_texts += part.num_rows

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of sorted blocks; equal ones stand side by side in one task and share a name."""
    base = TaskContext.get().partitionId() << _TASK_BITS
    last, n = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch["block"]
        new = np.ones(batch.num_rows, np.int64)
        new[1:] = pc.not_equal(blocks.slice(1), blocks.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = blocks[0].as_py() != last
        names = n + np.cumsum(new)
        last, n = blocks[batch.num_rows - 1].as_py(), int(names[-1])
        yield pa.RecordBatch.from_arrays(
            [batch["task"], batch["ref"], pa.array(names + base)], names=["_task", "_ref", "name"]
        )


def _paired(names: DataFrame) -> DataFrame:
    """Adjacent names of each text, paired and named anew."""
    even = F.col("pos") % 2 == 0
    pairs = stored(
        names.groupBy("task", "text_no", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max("n_blocks").alias("n_blocks"),
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_NAME).cast("bigint")).alias("b"),
        ),
        "pairs",
    )
    distinct = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct().sortWithinPartitions("_a", "_b")
    numbers = stored(distinct.withColumn("name", F.monotonically_increasing_id()), "pair-names")
    return stored(
        pairs.join(numbers, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select(
            "task", "text_no", "pos", "n_blocks", "name"
        ),
        "names",
    )


def _identities(names: DataFrame) -> DataFrame | None:
    """(task, text_no, level, name) of texts of more than one block; names of one level tell texts apart."""
    done, level = None, 0
    while not names.isEmpty():
        names, level = _paired(names), level + 1
        whole = F.col("n_blocks") <= 2**level
        found = names.filter(whole).select(
            F.col("task").alias("_task"), F.col("text_no").alias("_text_no"), F.lit(level).alias("level"), "name"
        )
        done = found if done is None else done.unionByName(found)
        names = names.filter(~whole)
    return done


def identified(docs: DataFrame) -> DataFrame:
    """task, text_no, doc_id, n_points, text_sha256 and the identity (level, name) of each row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"), F.char_length(text).cast("bigint").alias("n_points"))
    # Made here, since tasks give back the type of the column they were given.
    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    blocks = stored(
        read.mapInArrow(
            _blocks(kind_of),
            "task int, text_no bigint, pos int, n_blocks int, ref bigint, block binary, "
            f"doc_id {kind}, n_points bigint, text_sha256 string",
        ),
        "text-blocks",
    )
    sent = blocks.filter(F.col("block").isNotNull()).select("task", "ref", "block")
    numbers = sent.repartition("block").sortWithinPartitions("block").mapInArrow(_named, "_task int, _ref bigint, name bigint")
    first = stored(
        blocks.drop("block").join(numbers, (F.col("task") == F.col("_task")) & (F.col("ref") == F.col("_ref"))).drop(
            "_task", "_ref", "ref"
        ),
        "block-names",
    )
    own = ("task", "text_no", "doc_id", "n_points", "text_sha256")
    single = first.filter("n_blocks = 1").select(*own, F.lit(0).alias("level"), "name")
    longer = _identities(first.filter("n_blocks > 1").select("task", "text_no", "pos", "n_blocks", "name"))
    if longer is None:
        return single
    heads = first.filter("n_blocks > 1 AND pos = 0").select(*own)
    same = (F.col("task") == F.col("_task")) & (F.col("text_no") == F.col("_text_no"))
    return single.unionByName(heads.join(longer, same).drop("_task", "_text_no"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs`` (doc_id, text)."""
    rows = stored(identified(docs), "identities")
    order = F.struct(
        (-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "task", "text_no"
    )
    # Stored, so that both sides of the join are dealt out anew and rows of a large group can be split.
    groups = stored(
        rows.groupBy(F.col("level").alias("_level"), F.col("name").alias("_name")).agg(
            F.count("*").alias("group_size"), F.min(order).alias("first")
        ),
        "copy-groups",
    )
    is_first = (F.col("task") == F.col("first.task")) & (F.col("text_no") == F.col("first.text_no"))
    return rows.join(groups, (F.col("level") == F.col("_level")) & (F.col("name") == F.col("_name"))).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", is_first.alias("kept"), "text_sha256"
    )
