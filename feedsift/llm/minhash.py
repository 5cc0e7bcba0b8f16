"""Near-duplicate documents by fast similarity sketching.

A document is the set of its 5-word shingles. Documents with one set are a
class, and only one of a class is compared. A sketch has COORDS coordinates.
In round i every shingle is thrown by a hash into one coordinate with the value
i + hash; a coordinate keeps its least value. After COORDS rounds, round
COORDS + j throws all shingles into coordinate j, so every coordinate fills; a
document stops after the first round that leaves none empty, so most texts need
one or two. BANDS groups of ROWS coordinates name buckets.

Candidates come from buckets in two steps that never list all pairs of one:
1. each member with its bucket's least member; of these pairs the most similar
   by sketch is tested for each member, which joins most of a group of copies;
2. members of a bucket that are not in one component yet. Buckets of up to
   SMALL members list these pairs; larger ones are cut into blocks that meet
   in tasks, where sketches, then whole sets are compared, and only links that
   join components leave the task.
Every link is confirmed on whole sets. At the threshold a pair shares no bucket
with a chance of 8e-7, and a sketch says less than AGREE with one of 1e-8.

Cases: a null or empty text has no shingle and links with nothing; rows without
a doc_id link with nothing and are kept; repeated rows and equal sets are one
class; an empty table gives an empty result; no limit on lengths or groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.llm.batches import arrow_map, gram_hashes, list_array, mixed, words_of
from feedsift.llm.components import components
from feedsift.llm.scratch import stored, text_key

SHINGLE_WORDS = 5
LEAST_PERCENT = 85
BANDS, ROWS = 24, 5
COORDS = BANDS * ROWS
AGREE = 78  # coordinates in which a sketch pair must agree to be tested
HUB_AGREE = 90
SMALL = 24
BLOCK = 1024

_U = np.uint64


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    words = words_of(texts, lower=True)
    hashes = words.hashes()
    found, sizes = [np.zeros(0, _U)], [0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = gram_hashes(hashes[a:b], min(SHINGLE_WORDS, b - a)) if b > a else hashes[:0]
        own = np.sort(own)
        own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        found.append(own)
        sizes.append(len(own))
    return np.concatenate(found), np.cumsum(sizes)


def sketches(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COORDS values per set; sets without elements keep the largest number."""
    n = len(first) - 1
    most = np.iinfo(_U).max
    values = np.full(n * COORDS, most, _U)
    owner = np.repeat(np.arange(n), np.diff(first))
    for turn in range(2 * COORDS):
        if not len(elements):
            break
        thrown = mixed(elements + _U(0x632BE59BD9B4E019 * (turn + 1) % 2**64))
        place = thrown % _U(COORDS) if turn < COORDS else np.full(len(thrown), turn - COORDS, _U)
        value = (thrown >> _U(8)) >> _U(8) | _U(turn << 48)
        np.minimum.at(values, owner * COORDS + place.astype(np.int64), value)
        empty = (values.reshape(n, COORDS) == most).any(axis=1)
        still = empty[owner]
        elements, owner = elements[still], owner[still]
    return values.reshape(n, COORDS)


def _sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    elements, first = shingle_sets(batch["text"])
    sizes = np.diff(first)
    values = sketches(elements, first)
    names = np.zeros((len(sizes), 2), _U)
    filled = np.flatnonzero(sizes)
    for k in range(2):
        if len(filled):
            names[filled, k] = np.add.reduceat(mixed(elements + _U(k)), first[filled])
    band_salt = mixed(np.arange(1, BANDS + 1, dtype=_U))
    grouped = mixed(values.reshape(-1, BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))
    bands = mixed(grouped.sum(axis=2, dtype=_U) + band_salt)
    keep = np.repeat(np.where(sizes > 0, BANDS, 0)[:, None], 1, axis=1).ravel()
    offsets = np.concatenate([[0], np.cumsum(keep)])
    short = (mixed(values) & _U(0xFFFF)).astype("<u2")
    return pa.RecordBatch.from_arrays(
        [
            batch["doc_id"], batch["text_key"], pa.array(sizes, pa.int64()),
            pa.array([row.tobytes() for row in names], pa.binary()),
            list_array(bands[sizes > 0].ravel().view(np.int64), offsets, pa.int64()),
            pa.array([row.tobytes() for row in short], pa.binary()),
        ],
        names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "sketch"],
    )


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    elements, first = shingle_sets(batch["text"])
    return pa.RecordBatch.from_arrays(
        [batch["set_key"], list_array(elements.view(np.int64), first, pa.int64())], names=["set_key", "shingles"]
    )


def sketched(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(
        docs.select("doc_id", text_key().alias("text_key"), "text"), _sketched,
        f"doc_id {kind}, text_key bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary",
    )


def _near(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of similar size whose sketches agree in ``least`` coordinates, with ``agree``."""
    for side in ("a", "b"):
        own = classes.select(
            F.col("set_key").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")
        )
        pairs = pairs.join(own, side)
    sized = pairs.filter(
        100 * F.least("n_a", "n_b") >= LEAST_PERCENT * F.greatest("n_a", "n_b")
    ).select("a", "b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, COORDS) for c in ("sketch_a", "sketch_b")
            ]
            agree = (both[0] == both[1]).sum(axis=1)
            rows = pa.array(np.flatnonzero(agree >= least))
            yield pa.RecordBatch.from_arrays(
                [batch["a"].take(rows), batch["b"].take(rows), pa.array(agree, pa.int32()).take(rows)],
                names=["a", "b", "agree"],
            )

    return sized.mapInArrow(run, "a binary, b binary, agree int")


def _shingles_of(named: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """Sets of the classes named in ``keys`` (set_key), made again from one text each."""
    wanted = classes.join(keys, "set_key").select(
        "set_key", F.col("at.doc_id").alias("_id"), F.col("at.text_key").alias("_key")
    )
    texts = named.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")))
    made = arrow_map(texts.select("set_key", "text"), _sets, "set_key binary, shingles array<bigint>")
    return stored(made.dropDuplicates(["set_key"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by their whole sets."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set_key").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.filter(100 * both >= LEAST_PERCENT * either).select("a", "b")


def _hub_links(members: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """Links between members and the least member of one of their buckets."""
    pairs = members.filter("set_key <> hub").select(F.col("hub").alias("a"), F.col("set_key").alias("b")).distinct()
    best = stored(
        _near(pairs, classes, HUB_AGREE).groupBy("b").agg(F.max(F.struct("agree", "a")).alias("m"))
        .select(F.col("m.a").alias("a"), "b"),
        "hub-pairs",
    )
    keys = best.select(F.col("a").alias("set_key")).union(best.select("b")).distinct()
    return stored(_confirmed(best, _shingles_of(named, classes, keys)), "links")


def _small_pairs(mixed_members: DataFrame) -> DataFrame:
    """Pairs across components in buckets of few members."""
    grouped = mixed_members.filter(F.col("size") <= SMALL).groupBy("band").agg(
        F.collect_list(F.struct("set_key", "root")).alias("m")  # SMALL rows at most
    )
    pairs = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (x["set_key"] < y["set_key"]) & (x["root"] != y["root"])),
        lambda y: F.struct(x["set_key"].alias("a"), y["set_key"].alias("b")),
    )))
    return grouped.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _blocks(mixed_members: DataFrame) -> DataFrame:
    """Members of large buckets, dealt to the blocks in which they meet.

    The largest component of a bucket is not compared with itself: a block has
    up to about BLOCK members outside it (left) and as many of all (right).
    """
    large = mixed_members.filter(F.col("size") > SMALL)
    shares = large.groupBy("band", "root").agg(F.count("*").alias("n"))
    major = shares.groupBy("band").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")
    ).select(F.col("band").alias("_band"), F.col("top.root").alias("major"), F.col("top.n").alias("in_major"), "all")
    rows = large.join(major, F.col("band") == F.col("_band")).withColumns({
        "left": F.col("root") != F.col("major"),
        "lefts": F.ceil((F.col("all") - F.col("in_major")) / BLOCK).cast("int"),
        "rights": F.ceil(F.col("all") / BLOCK).cast("int"),
        "deal": F.xxhash64("set_key"),
    })
    as_left = rows.filter("left").select(
        "band", "set_key", "root", "left", F.pmod("deal", F.col("lefts")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), F.lit(True).alias("as_left"),
    )
    as_right = rows.select(
        "band", "set_key", "root", "left", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"),
        F.pmod("deal", F.col("rights")).cast("int").alias("j"), F.lit(False).alias("as_left"),
    )
    return as_left.unionByName(as_right)


def _pair_mask(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Pairs of a block to be compared: other components, like sizes, each pair once."""
    a, b = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
    low, high = np.minimum(a[:, None], b), np.maximum(a[:, None], b)
    other = left["root"].to_numpy()[:, None] != right["root"].to_numpy()
    once = ~right["left"].to_numpy() | (left["set_key"].to_numpy()[:, None] < right["set_key"].to_numpy())
    return (100 * low >= LEAST_PERCENT * high) & other & once


def _promising(group: pd.DataFrame) -> pd.DataFrame:
    """Members of a block with a partner by sketch."""
    left, right = group[group["as_left"]], group[~group["as_left"]]
    mask = _pair_mask(left, right)
    if mask.any():
        a, b = (np.frombuffer(b"".join(x["sketch"]), "<u2").reshape(-1, COORDS) for x in (left, right))
        agree = np.zeros(mask.shape, np.int16)
        for k in range(COORDS):
            agree += a[:, k, None] == b[:, k]
        mask &= agree >= AGREE
    chosen = pd.concat([left[mask.any(axis=1)], right[mask.any(axis=0)]])
    return chosen[["band", "i", "j", "set_key", "root", "left", "as_left", "n_shingles"]]


def _joining(group: pd.DataFrame) -> pd.DataFrame:
    """Links of a block, as many as join its components."""
    left, right = group[group["as_left"]], group[~group["as_left"]]
    mask = _pair_mask(left, right)
    sizes_a, sizes_b = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
    links: list[tuple[bytes, bytes]] = []
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in up:
            x = up[x]
        return x

    if mask.any():
        flat = np.concatenate(right["shingles"].to_list())
        first = np.concatenate([[0], np.cumsum(sizes_b)[:-1]])
        for i in np.flatnonzero(mask.any(axis=1)).tolist():
            own = np.sort(left["shingles"].iloc[i])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[at] == flat).astype(np.int64), first)
            linked = mask[i] & (100 * both >= LEAST_PERCENT * (sizes_a[i] + sizes_b - both))
            for j in np.flatnonzero(linked).tolist():
                a, b = top(left["root"].iloc[i]), top(right["root"].iloc[j])
                if a != b:
                    up[a] = b
                    links.append((left["set_key"].iloc[i], right["set_key"].iloc[j]))
    return pd.DataFrame(links, columns=["a", "b"])


def _cross_links(members: DataFrame, labels: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """Links between members of a bucket that are in different components so far."""
    roots = labels.select(F.col("node").alias("_node"), "root")
    rooted = members.join(roots, F.col("set_key") == F.col("_node"), "left").select(
        "band", "set_key", F.coalesce("root", "set_key").alias("root")
    )
    apart = rooted.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")
    ).filter("low <> high").select(F.col("band").alias("_band"), "size")
    across = stored(rooted.join(apart, F.col("band") == F.col("_band")).drop("_band"), "across")
    small = stored(_near(_small_pairs(across), classes, AGREE).select("a", "b"), "small-pairs")

    narrow = classes.select("set_key", "n_shingles", "sketch")
    block = ["band", "i", "j"]
    promising = stored(
        _blocks(across).join(narrow, "set_key").groupBy(*block).applyInPandas(
            _promising,
            "band bigint, i int, j int, set_key binary, root binary, left boolean, as_left boolean, n_shingles bigint",
        ),
        "promising",
    )
    keys = (
        small.select(F.col("a").alias("set_key")).union(small.select("b")).union(promising.select("set_key")).distinct()
    )
    sets = _shingles_of(named, classes, keys)
    large = promising.join(sets, "set_key").groupBy(*block).applyInPandas(_joining, "a binary, b binary")
    return _confirmed(small, sets).unionByName(large)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of each row."""
    rows = stored(sketched(docs), "sketches")
    named = docs.select("doc_id", text_key().alias("text_key"), "text")
    classes = stored(
        rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_key").agg(
            F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    placed = classes.select(F.explode("bands").alias("band"), "set_key")
    shared = placed.groupBy("band").agg(F.min("set_key").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = stored(placed.join(shared.select(F.col("band").alias("_band"), "hub"), F.col("band") == F.col("_band")).drop("_band"), "members")
    links = _hub_links(members, classes, named)
    labels = components(links)
    links = links.unionByName(_cross_links(members, labels, classes, named))
    labels = components(links)
    return _labelled(rows, classes, labels)


def _labelled(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    rooted = stored(
        classes.join(labels, F.col("set_key") == F.col("node"), "left").select(
            "set_key", F.coalesce("root", "set_key").alias("root"), F.col("at.doc_id").alias("low")
        ),
        "rooted",
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "_root")
    to = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("set_key").alias("_set_key"), "component_id")
    single: Column = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(single, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(to, F.col("set_key") == F.col("_set_key"), "left").select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
