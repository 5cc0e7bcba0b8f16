"""Substring dedup by relative Lempel-Ziv factors: words go that stand in a passage which earlier documents hold.

The reference of a document is every document with a smaller id. It is indexed
in blocks: each window of WINDOW words belongs to the block of its seed, the
least hash of the SEED_WORDS-word grams in it, so equal windows meet in one
block wherever they stand. Neighbouring windows with one seed form a run; a
block holds the distinct runs of its seed, and per window the reference place
that comes first: smallest doc_id, then run, then place in it.

A document is factored against every block its seeds lie in; in any other block
nothing of it can stand. The parse goes through a run from left to right and
makes each factor as long as the windows follow one another in the reference
run where it began; then the next factor begins. A window found nowhere is no
factor. So a factor of n windows is a passage of n + WINDOW - 1 words, never
shorter than WINDOW. Factors overlap: the windows that lie across a boundary
are the first ones of the next factor, and are looked up like all others.
Equal runs are parsed once, whatever number of documents they stand in; of the
factors, a document loses those whose reference is an earlier document. All
windows are judged on the input.

Windows count as equal if two independent 64-bit hashes agree (seed, window).
Cases: texts of fewer words than WINDOW keep all; null texts have no words;
rows without a doc_id are neither reference nor shortened; rows with one doc_id
never shorten each other; repeated rows get equal results; an empty table gives
an empty result; no limit on a text's length.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.llm.batches import Words, arrow_map, gram_hashes, kept_text, list_array, mixed, sliding_min, words_of
from feedsift.llm.scratch import stored, text_key

WINDOW = 50
SEED_WORDS = 20
RUN_WINDOWS = 48  # a longer run is cut, so that what one group gathers is bounded


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, seed and hash of each window that lies in one text."""
    hashes = words.hashes()
    whole = gram_hashes(hashes, WINDOW)
    if not len(whole):
        return np.zeros(0, np.int64), whole.view(np.int64), whole.view(np.int64)
    seeds = sliding_min(gram_hashes(hashes, SEED_WORDS), WINDOW - SEED_WORDS + 1)
    last = np.repeat(words.first[1:], words.counts())[:len(whole)]
    at = np.flatnonzero(np.arange(len(whole)) + WINDOW <= last)
    return at, seeds[at].view(np.int64), whole[at].view(np.int64)


def _seeded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What a text is if nothing goes, and its distinct seeds."""
    words = words_of(batch["text"])
    at, seeds, _ = _windows(words)
    owner = np.searchsorted(words.first, at, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(words.n_rows + 1))
    new = np.ones(len(seeds), bool)
    new[1:] = (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])
    lists = [np.unique(seeds[a:b][new[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    joined, rows = kept_text(words, np.ones(len(words.start), bool))
    whole = [sha256(joined[a:b]).hexdigest() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            batch["doc_id"], batch["text_key"], pa.array(words.counts(), pa.int64()), pa.array(whole),
            list_array(np.concatenate(lists) if lists else seeds, offsets, pa.int64()),
        ],
        names=["doc_id", "text_key", "n_words", "whole_sha256", "seeds"],
    )


def _runs(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Runs of windows with a shared seed: where they begin, and their windows."""
    words = words_of(batch["text"])
    at, seeds, hashes = _windows(words)
    shared = np.unique(np.asarray(pa.chunked_array([batch["shared"]]).combine_chunks().flatten()))
    held = np.isin(seeds, shared)
    at, seeds, hashes = at[held], seeds[held], hashes[held]
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (seeds[1:] != seeds[:-1])
    begin = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    inside %= RUN_WINDOWS
    first = np.flatnonzero(inside == 0)
    value = mixed(hashes.view(np.uint64) + mixed(inside.astype(np.uint64)))
    name = np.add.reduceat(value, first)
    owner = np.searchsorted(words.first, at[first], side="right") - 1
    owner_rows = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [
            batch["doc_id"].take(owner_rows), batch["text_key"].take(owner_rows),
            pa.array(seeds[first], pa.int64()), pa.array(name.view(np.int64), pa.int64()),
            pa.array(at[first] - words.first[owner], pa.int64()),
            list_array(hashes, np.append(first, len(at)), pa.int64()),
        ],
        names=["doc_id", "text_key", "seed", "run", "start", "windows"],
    )


def _covered(words: Words, factors: list) -> np.ndarray:
    """Words that lie in a factor."""
    gone = np.zeros(len(words.start) + 1, np.int64)
    for row, found in enumerate(factors):
        base = words.first[row]
        for factor in found or ():
            gone[base + factor["start"]] += 1
            gone[base + factor["start"] + factor["n_words"]] -= 1
    return np.cumsum(gone[:-1]) > 0


def _shortened(with_text: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch["text"])
        gone = _covered(words, batch["factors"].to_pylist())
        joined, rows = kept_text(words, ~gone)
        texts = [joined[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        total = np.concatenate([[0], np.cumsum(gone)])
        columns = [
            batch["doc_id"], batch["text_key"],
            pa.array(np.diff(total[words.first]), pa.int64()),
            pa.array([sha256(t).hexdigest() for t in texts]),
        ]
        names = ["doc_id", "text_key", "n_removed", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array([t.decode() for t in texts])], [*names, "kept_text"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return work


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["doc_id"] == b["doc_id"]) & (a["text_key"] == b["text_key"])


def _parsed(places: Column, kind: str) -> Column:
    """Factors of a run, whose windows come in order with the place each has in the reference."""
    none = F.array().cast(f"array<struct<place: int, n: int, holder: {kind}, source: bigint, shift: int>>")

    def step(done: Column, window: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(
            last["place"].alias("place"), (last["n"] + 1).alias("n"), last["holder"].alias("holder"),
            last["source"].alias("source"), last["shift"].alias("shift"),
        )
        new = F.struct(
            window["place"].alias("place"), F.lit(1).alias("n"), window["holder"].alias("holder"),
            window["source"].alias("source"), window["shift"].alias("shift"),
        )
        follows = (last["source"] == window["source"]) & (last["shift"] == window["shift"])
        return (
            F.when(follows, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer))
            .otherwise(F.array_append(done, new))
        )

    return F.aggregate(places, none, step)


def parsed_runs(runs: DataFrame, kind: str) -> DataFrame:
    """seed, run and phrases (factors against the block of the seed) of each distinct run."""
    distinct = runs.groupBy("seed", "run").agg(F.min("doc_id").alias("first_doc"), F.first("windows").alias("windows"))
    opened = stored(
        distinct.select("seed", "run", "first_doc", F.posexplode("windows").alias("place", "window")), "windows"
    )
    block = opened.groupBy("seed", "window").agg(F.min(F.struct("first_doc", "run", "place")).alias("at"))
    placed = opened.join(block, ["seed", "window"]).select(
        "seed", "run",
        F.struct(
            "place", F.col("at.first_doc").alias("holder"), F.col("at.run").alias("source"),
            (F.col("at.place") - F.col("place")).alias("shift"),
        ).alias("window"),
    )
    return (
        placed.groupBy("seed", "run").agg(F.array_sort(F.collect_list("window")).alias("places"))
        .select("seed", "run", _parsed(F.col("places"), kind).alias("phrases"))
    )


def duplicate_factors(seeded: DataFrame, named: DataFrame, kind: str) -> DataFrame:
    """doc_id, text_key and factors (start, n_words, source_doc) of documents that lose words."""
    carried = seeded.filter(F.col("doc_id").isNotNull()).select("doc_id", "text_key", F.explode("seeds").alias("seed"))
    common = (
        carried.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter(F.col("low") < F.col("high")).select("seed")
    )
    shared = carried.join(common, "seed").groupBy("doc_id", "text_key").agg(F.collect_set("seed").alias("shared"))
    opened = named.join(shared, _same(named, shared)).select(named["doc_id"], named["text_key"], "text", "shared")
    runs = stored(
        arrow_map(
            opened, _runs,
            f"doc_id {kind}, text_key bigint, seed bigint, run bigint, start bigint, windows array<bigint>",
        ),
        "runs",
    )
    parsed = parsed_runs(runs, kind).withColumnsRenamed({"seed": "_seed", "run": "_run"})
    earlier = F.filter("phrases", lambda f: f["holder"] < F.col("doc_id"))
    factors = F.transform(earlier, lambda f: F.struct(
        (F.col("start") + f["place"]).alias("start"), (f["n"] + (WINDOW - 1)).alias("n_words"), f["holder"].alias("source_doc"),
    ))
    found = (
        runs.join(parsed, (F.col("seed") == F.col("_seed")) & (F.col("run") == F.col("_run")))
        .select("doc_id", "text_key", factors.alias("factors")).filter(F.size("factors") > 0)
    )
    return found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("factors")).alias("factors"))


def remove_substrings(docs: DataFrame, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """What each row is as a whole, and what becomes of the rows that lose words."""
    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select("doc_id", text_key().alias("text_key"), "text")
    seeded = stored(
        arrow_map(
            named, _seeded,
            f"doc_id {kind}, text_key bigint, n_words bigint, whole_sha256 string, seeds array<bigint>",
        ),
        "seeds",
    )
    factors = stored(duplicate_factors(seeded, named, kind), "factors")
    losing = named.join(factors, _same(named, factors)).select(named["doc_id"], named["text_key"], "text", "factors")
    schema = f"doc_id {kind}, text_key bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return seeded.drop("seeds"), arrow_map(losing, _shortened(with_text), schema)


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of what is kept, of each row."""
    whole, shorter = remove_substrings(docs)
    changed = shorter.dropDuplicates(["doc_id", "text_key"])
    return whole.join(changed, _same(whole, changed), "left").select(
        whole["doc_id"], "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )
