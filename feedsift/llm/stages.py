"""Pipeline stages: each takes documents and returns documents, the last one pieces.

Stages carry every column of their input. A row is named by its doc_id and the
key of its text, so repeated rows share a verdict; rows without a doc_id are
judged by text alone where a rule looks at one text, and linked with nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.llm import minhash, packing, quality, secrets, substring
from feedsift.llm.scratch import stored, text_key

def _beside(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """``found`` with its columns renamed, and the condition that joins it to rows of ``docs``."""
    other = found.select([F.col(c).alias(f"__stage_{c}") for c in found.columns])
    same = docs["doc_id"].eqNullSafe(F.col("__stage_doc_id")) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__stage_text_key")
    )
    return other, same


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text key are not in ``dropped``.

    One plan at every size: both sides are dealt out by key, and the narrow one is
    looked up, so texts are moved once and not sorted.
    """
    other, same = _beside(docs, dropped)
    return docs.join(other.hint("shuffle_hash"), same, "left_anti")


def _with_text(docs: DataFrame, found: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``text`` where ``found`` has the row; n_chars follows."""
    joined = docs.join(*_beside(docs, found), "left")
    changed = F.col("__stage_text_key").isNotNull()
    new = {"text": F.when(changed, text).otherwise(docs["text"])}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(changed, F.char_length(text).cast(kind)).otherwise(docs["n_chars"])
    return joined.select([new.get(c, docs[c]).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    named = docs.select("doc_id", text_key().alias("text_key"), "lang", "source", "text")
    verdicts = quality.quality_verdicts(named, ("doc_id", "text_key", "lang", "source"))
    dropped = verdicts.filter(~F.col("kept")).select("doc_id", "text_key").distinct()
    return _without(docs, stored(dropped, "rejected"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id."""
    dropped = minhash.near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept"))
    return _without(docs, stored(dropped.select("doc_id", "text_key").distinct(), "copies"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words in passages that earlier documents hold."""
    _, shorter = substring.remove_substrings(docs.select("doc_id", "text"), with_text=True)
    changed = stored(shorter.select("doc_id", "text_key", "kept_text").dropDuplicates(["doc_id", "text_key"]), "shorter")
    return _with_text(docs, changed, F.col("__stage_kept_text"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    found = secrets.secret_spans(docs.select("doc_id", "text")).filter(F.size("spans") > 0)
    spans = stored(found.dropDuplicates(["doc_id", "text_key"]), "spans")
    return _with_text(docs, spans, secrets.masked(docs["text"], F.col("__stage_spans")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
