"""Vectorised word work on Arrow batches, for use inside tasks.

A word is a run of bytes outside 0x20 and 0x09-0x0D; these bytes never occur
inside a longer UTF-8 character, so all work is done on the bytes of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once; a longer text makes a batch of its own.
BATCH_BYTES = 2 << 20

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)

# The separators between words.
SEPARATORS = b"\x09\x0a\x0b\x0c\x0d\x20"
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODES = mixed(np.arange(1, 257, dtype=_U) * _U(_ODD))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, up to n - 1 at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def sliced(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BATCH_BYTES of the named text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of a batch of texts, in order."""

    data: np.ndarray  # bytes of all texts
    rows: np.ndarray  # offset of each text in data, and the end
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the count

    @property
    def n_rows(self) -> int:
        return len(self.rows) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, _U)
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_BYTE_CODES[self.data] * up[:len(self.data)], dtype=_U, out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * down[self.start]
        return mixed(value + (self.end - self.start).astype(_U))

    def text(self, keep: slice | np.ndarray) -> bytes:
        """The chosen words joined by one space."""
        raw = self.data.tobytes() if self.n_rows == 1 else None
        start, end = self.start[keep].tolist(), self.end[keep].tolist()
        if raw is not None:
            return b" ".join([raw[a:b] for a, b in zip(start, end, strict=True)])
        if not start:
            return b""
        low = start[0]
        raw = self.data[low:end[-1]].tobytes()
        return b" ".join([raw[a - low:b - low] for a, b in zip(start, end, strict=True)])


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text, A-Z taken as a-z if ``lower``."""
    data, rows = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_IS_SEPARATOR[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[rows] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[rows] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, rows, start, end, np.searchsorted(start, rows))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(words) < n:
        return np.zeros(0, _U)
    up, down = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[:len(words)], dtype=_U, out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[:len(words) - n + 1])


def arrow_map(frame, work: Callable, schema: str, text: str = "text"):
    """``work(batch) -> batch`` over batches of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            made = work(batch)
            if made is not None and made.num_rows:
                yield made

    return frame.mapInArrow(run, schema)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of lists over one flat array."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def kept_text(words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words joined by one blank: the bytes of all texts, and where each begins."""
    numbers = np.flatnonzero(keep)
    owner = np.searchsorted(words.first, numbers, side="right") - 1
    inner = np.append(owner[1:] == owner[:-1], False) if len(numbers) else np.zeros(0, bool)
    marks = np.zeros(len(words.data) + 1, np.int8)
    marks[words.start[numbers]] = 1
    marks[words.end[numbers]] -= 1
    taken = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    data = words.data.copy()
    blanks = words.end[numbers[inner]]  # a further word follows, so a separator stands there
    data[blanks] = 0x20
    taken[blanks] = True
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(taken, out=sizes[1:])
    return data[taken].tobytes(), sizes[words.rows]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values that follow one another."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
