"""Token ids of whole texts by the tokenizers library, one look-up per distinct piece.

A text is cut where no token can cross: word tokenizers drop blanks, and a byte
tokenizer never has a token that goes on from a non-blank to a blank. Distinct
pieces of a batch are encoded by the library once, and a bounded memo in each
worker keeps what it has seen, so the result is that of encoding whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from feedsift.llm.batches import words_of

# Distinct pieces that a worker remembers; others are encoded again.
MEMO_PIECES = 400_000
# Pieces encoded in one call.
JOINED = 500

# Blanks outside ASCII; a byte tokenizer takes texts with them whole.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_BLANK = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


class Memo:
    """Ids (little-endian unsigned 32-bit) by piece, over a function that encodes new pieces."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.known: dict[str, bytes] = {"": b""}

    def ids(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            made = self.encode([pieces[i] for i in new])
            for i, ids in zip(new, made, strict=True):
                found[i] = ids
            if len(self.known) < MEMO_PIECES:
                self.known.update((pieces[i], found[i]) for i in new)
        return found


def id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _token_sizes(tokenizer, suffix: str) -> np.ndarray:
    """Bytes of text that each token stands for."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, number in vocab.items():  # one letter per byte
        sizes[number] = len(token.removesuffix(suffix)) if token != suffix else len(token)
    return sizes


@lru_cache(maxsize=4)
def library_memo(path: str) -> Memo:
    """One tokenizer and memo per worker and file.

    Pieces that normalisation leaves alone are encoded many at a time, joined
    where no token can cross; the ids are cut by the bytes they stand for. If
    these do not add up to the pieces', the pieces are encoded one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    keeps_blanks = spec["normalizer"] is None
    sizes = _token_sizes(tokenizer, spec["model"].get("end_of_word_suffix") or "\0")
    between = "" if keeps_blanks else " "

    def fits(piece: str) -> bool:
        if keeps_blanks:
            return piece[0] in BLANKS and piece[-1] not in BLANKS
        return piece.isascii() or unicodedata.is_normalized("NFC", piece) and piece == piece.lower()

    def one_by_one(pieces: list[str]) -> list[bytes]:
        return [id_bytes(x.ids) for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(pieces: list[str]) -> list[bytes]:
        made: list[bytes] = [b""] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p and fits(p)]
        rest = [i for i, p in enumerate(pieces) if p and not fits(p)]
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        joined = [between.join([pieces[i] for i in g]) for g in groups]
        for group, found in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            reach = np.cumsum(sizes[ids])
            ends = np.cumsum([len(pieces[i].encode()) for i in group])
            cuts = np.searchsorted(reach, ends) + 1
            if not len(ids) or reach[-1] != ends[-1] or cuts[-1] != len(ids) or (reach[cuts - 1] != ends).any():
                rest += group
                continue
            raw, at = ids.tobytes(), 0
            for i, cut in zip(group, (cuts * 4).tolist(), strict=True):
                made[i] = raw[at:cut]
                at = cut
        for i, ids in zip(rest, one_by_one([pieces[i] for i in rest]), strict=True):
            made[i] = ids
        return made

    return Memo(encode)


def word_pieces(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Blank-free pieces of all texts, and the first piece of each text.

    For tokenizers that lower-case and keep letters apart from signs: pieces
    are lower-cased (A-Z) unless a special token may be in the batch, and full
    stops and commas behind a word are pieces of their own (not behind a letter
    whose small form ends in a mark).
    """
    texts = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    texts = pc.replace_substring_regex(texts, r"([^\PL\x{130}])([.,]+)([\t-\r ]|$)", r"\1 \2\3")
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()


def blank_led_pieces(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Pieces that begin where a blank follows a word, or a stop or comma a letter; together they are the texts."""
    words = words_of(texts)
    data = words.data
    stops = np.flatnonzero((data == 0x2E) | (data == 0x2C))
    before = data[stops - 1]  # of a first byte: the last, where a cut is in any case
    small = before | 0x20
    letter = (small >= 0x61) & (small <= 0x7A)
    latin = (data[stops - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) if len(data) > 1 else letter
    is_cut = np.zeros(len(data) + 1, bool)
    for places in (words.end, words.rows, stops[letter | latin]):
        is_cut[places] = True
    cuts = np.flatnonzero(is_cut)
    offsets = pa.array(cuts, pa.int32()).buffers()[1]
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, offsets, pa.py_buffer(words.data.tobytes()))
    return pieces, np.searchsorted(cuts, words.rows)


def joined(found: list[bytes], codes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """What stands for each text: the values of its pieces, one after another."""
    numbers, value = codes.tolist(), found.__getitem__
    return [b"".join(map(value, numbers[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def text_ids(texts: pa.Array, path: str, blanks_count: bool) -> list[bytes]:
    """Ids of each text; ``blanks_count`` for tokenizers that keep blanks."""
    memo = library_memo(path)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    pieces, first = blank_led_pieces(texts) if blanks_count else word_pieces(texts)
    coded = pieces.dictionary_encode()
    made = joined(memo.ids(coded.dictionary.to_pylist()), coded.indices.to_numpy(), first)
    if blanks_count:
        wide = pc.fill_null(pc.match_substring_regex(texts, WIDE_BLANK), False)
        for i in np.flatnonzero(wide.to_numpy(zero_copy_only=False)).tolist():
            made[i] = memo.encode([texts[i].as_py()])[0]
    return made
