"""Quality rules with thresholds learnt per language and source.

Each text gets a few counts. Shares made of them go into a mergeable quantile
sketch per language and source: a count per share value, values kept to seven
significant bits, so that a sketch has a bounded number of cells, is exact to
one part in 64, and two sketches merge by adding. Groups of few rows take the
sketch merged over the sources of their language, or over everything.

A threshold stands where the sketch shows that a group falls into two: in the
upper quarter of its quantiles, percent by percent, at the first large step from
one to the next, half-way up that step. A source whose texts reach high shares
without such a step gets none. A step below ``GUARD`` is no step, so that small
differences between sound texts reject nothing.

Cases: a null text has no words; null languages and sources are groups of
their own; repeated rows count each time and get one verdict; an empty table
gives an empty result. Long texts are counted whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsift.llm.batches import arrow_map, gram_hashes, words_of
from feedsift.llm.scratch import stored

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_BLANKS = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# A group needs this many rows for thresholds of its own.
MIN_GROUP_ROWS = 200
# Thresholds stand above this percentage of a group's rows.
FROM_PERCENT = 75
# Shares, in ten-thousandths, with the least step between two percentiles that splits a group.
GUARD = {"symbol_share": 300, "dup_line_share": 3000, "repeat_share": 3000, "word_length": 20000}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated(hashes: np.ndarray) -> int:
    """Words in a 3-word window that occurs twice or more."""
    grams = gram_hashes(hashes, 3)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(hashes), bool)
    for step in range(3):
        covered[order[1:][same] + step] = True
        covered[order[:-1][same] + step] = True
    return int(covered.sum())


def _line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = Counter(line for line in text.split("\n") if line.strip(_BLANKS))
    n = sum(lines.values())
    return n, n - len(lines)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch["text"]
    words = words_of(texts)
    hashes = words.hashes()
    inside = np.zeros(len(words.data) + 1, np.int64)
    marks = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(marks, words.start, 1)
    np.add.at(marks, words.end, -1)
    in_word = np.cumsum(marks[:-1]).astype(bool)
    np.cumsum(in_word & ((words.data & 0xC0) != 0x80), out=inside[1:])
    symbols = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_IS_SYMBOL[words.data], out=symbols[1:])
    lines = [_line_counts(t or "") for t in texts.to_pylist()]
    repeats = [_repeated(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    made = {
        "n_words": words.counts(),
        "word_chars": np.diff(inside[words.rows]),
        "n_symbols": np.diff(symbols[words.rows]),
        "n_lines": np.array([n for n, _ in lines], np.int64),
        "n_dup_lines": np.array([n for _, n in lines], np.int64),
        "n_repeat_words": np.array(repeats, np.int64),
    }
    others = [n for n in batch.schema.names if n != "text"]
    return pa.RecordBatch.from_arrays(
        [batch[n] for n in others] + [pa.array(made[n], pa.int64()) for n in COUNTS],
        names=[*others, *COUNTS],
    )


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` and the counts of each text."""
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes if n != "text")
    schema += "".join(f", {n} bigint" for n in COUNTS)
    return arrow_map(kept, _counted, schema)


def shares() -> dict[str, Column]:
    """The sketched measures, as whole ten-thousandths."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * 10000 / F.col(whole))).otherwise(0).cast("bigint")

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def cell(value: Column) -> Column:
    """The value cut to its seven highest bits."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    step = F.pow(F.lit(2), drop).cast("bigint")
    return (value - value % step).cast("bigint")


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, measure, cell, n: one sketch per group and measure."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("measure"), cell(value).alias("cell")) for name, value in shares().items()
    ])
    return (
        counts.select("lang", "source", F.explode(pairs).alias("p"))
        .groupBy("lang", "source", "p.measure", "p.cell").agg(F.count("*").alias("n"))
    )


def limits(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, rows and the limit (null: none) that merged sketches give."""
    merged = cells.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    by = [*keys, "measure"]
    upto = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(Window.partitionBy(*by)))
    # A cell is the percentiles from the first that the cells before it do not reach to the last that it reaches.
    last = F.floor(F.col("upto") * 100 / F.col("rows"))
    first = F.floor((F.col("upto") - F.col("n")) * 100 / F.col("rows")) + 1
    held = ranked.filter((last >= first) & (last >= FROM_PERCENT))
    after = F.lead("cell").over(Window.partitionBy(*by).orderBy("cell"))
    guard = F.create_map(*[x for k, v in GUARD.items() for x in (F.lit(k), F.lit(v))])
    steps = held.withColumn("after", after).withColumn("step", F.col("after") - F.col("cell"))
    splits = F.min(F.when(F.col("step") >= guard[F.col("measure")], F.struct("cell", "step")))
    return steps.groupBy(*by).agg(F.max("rows").alias("rows"), splits.alias("split")).select(
        *by, "rows", F.floor(F.col("split.cell") + F.col("split.step") / 2).alias("limit")
    )


def thresholds(cells: DataFrame) -> DataFrame:
    """lang, source and the upper limit of each measure in a row; null: none."""
    groups = limits(cells, ["lang", "source"])
    langs = limits(cells, ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"),
        F.col("rows").alias("l_rows"), F.col("limit").alias("l_limit"),
    )
    whole = limits(cells, []).select(F.col("measure").alias("w_measure"), F.col("limit").alias("w_limit"))
    joined = groups.join(
        langs, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))
    ).join(whole, F.col("measure") == F.col("w_measure"))
    limit = (
        F.when(F.col("rows") >= MIN_GROUP_ROWS, F.col("limit"))
        .when(F.col("l_rows") >= MIN_GROUP_ROWS, F.col("l_limit"))
        .otherwise(F.col("w_limit"))
    )
    found = joined.select("lang", "source", "measure", limit.cast("bigint").alias("limit"))
    return found.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == name, F.col("limit"))).alias(f"{name}_limit") for name in GUARD
    ])


def judged(counts: DataFrame) -> DataFrame:
    """``counts`` (read twice, so store it) with base_failed and kept."""
    found = thresholds(sketches(counts)).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"),
        *[F.col(f"{name}_limit") for name in GUARD],
    )
    within = F.lit(True)
    for name, value in shares().items():
        within = within & F.coalesce(value <= F.col(f"{name}_limit"), F.lit(True))
    return (
        counts.join(
            found,
            F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
            "left",
        )
        .drop("t_lang", "t_source")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & within)
    )


def quality_verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts, thresholds and verdict of each document; ``keep`` holds lang and source."""
    return judged(stored(text_counts(docs, keep), "quality"))
