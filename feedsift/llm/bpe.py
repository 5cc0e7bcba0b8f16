"""Byte-pair encoding by speculation: longest matches first, then a check of each pair.

A word is cut greedily into the longest tokens. Token by token this may differ
from merging, but a sequence is what merging gives exactly if no merge could
have joined two neighbours across their border before both were whole. That is
a property of the pair alone: it is looked at along the right edge of the one
and the left edge of the other, for all new pairs of a batch at once, and kept.
Only words with a failing pair are merged step by step.

Cases: null and empty texts have no tokens; a text's length is not limited;
special tokens in a text are found first, as the library does.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedsift.llm.batches import arrow_map
from feedsift.llm.tokens import Memo, joined, word_pieces

# Pairs whose verdict a worker remembers.
PAIRS_KEPT = 2_000_000
_NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for byte in range(256):
        if byte in prints:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(spare)
            spare += 1
    return letters


class Bpe:
    """A vocabulary of merges with word ends.

    Inside, a word is a string with one character per start symbol: a byte as
    U+0000-U+00FF, and the last byte of a word as U+0100-U+01FF.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        blank = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", blank))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials)))
        self.names = {i: t for t, i in [*vocab.items(), *self.specials.items()]}
        self._read_merges(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.pairs: dict[int, bool] = {}

    def _symbols(self, token: str) -> str:
        end = token.endswith(self.suffix) and token != self.suffix
        raw = [self._byte_of[c] for c in (token.removesuffix(self.suffix) if end else token)]
        if end:
            raw[-1] += 256
        return "".join(map(chr, raw))

    def _read_merges(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters = byte_letters()
        self._byte_of = {c: b for b, c in enumerate(letters)}
        start = {}
        for byte, letter in enumerate(letters):
            start[chr(byte)] = vocab.get(letter)
            start[chr(256 + byte)] = vocab.get(letter + self.suffix)
        size = max(vocab.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        made_at = np.full(size, _NEVER)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.tokens = {s: i for s, i in start.items() if i is not None}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((x, y), (rank, z))
            if self.left[z] < 0:
                self.left[z], self.right[z], made_at[z] = x, y, rank
                self.tokens[self._symbols(a + b)] = z
        # A token that merging its own symbols does not give is never proposed.
        self.start = start
        self.tokens = {s: i for s, i in self.tokens.items() if len(s) == 1 or self._merged(s) == [i]}
        self.longest = max(map(len, self.tokens))
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made_at = made_at

    def _merged(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost among equals."""
        ids = [self.start[c] for c in word]
        merges = self.merges
        while len(ids) > 1:
            best = min((merges[p] for p in zip(ids, ids[1:], strict=False) if p in merges), default=None)
            if best is None:
                break
            rank, made = best
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and merges.get((ids[i], ids[i + 1]), (-1,))[0] == rank:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _greedy(self, word: str) -> list[int]:
        tokens, longest, at, out = self.tokens, self.longest, 0, []
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                token = tokens.get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of x and y, _NEVER where there is none."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the border between tokens a and b.

        x walks down the right edge of a, y down the left edge of b; each is
        there until the merge that swallows it. A merge across the border
        happens if it comes before x's own, and not after y's own (of two
        equal merges the left one goes first).
        """
        fine = np.ones(len(a), bool)
        rows, x, x_until = np.arange(len(a)), a.copy(), np.full(len(a), _NEVER)
        while len(rows):
            left_rows, y, y_until = rows, b[rows], np.full(len(rows), _NEVER)
            xs, xs_until = x, x_until
            while len(left_rows):
                rank = self._pair_rank(xs, y)
                fine[left_rows[(rank < xs_until) & (rank <= y_until) & (rank < _NEVER)]] = False
                y_until, y = self.made_at[y], self.left[y]
                go = (y >= 0) & fine[left_rows]
                left_rows, y, y_until, xs, xs_until = left_rows[go], y[go], y_until[go], xs[go], xs_until[go]
            x_until, x = self.made_at[x], self.right[x]
            go = (x >= 0) & fine[rows]
            rows, x, x_until = rows[go], x[go], x_until[go]
        return fine

    def _encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit: guessed, checked pair by pair, merged where a pair fails."""
        guess = [self._greedy(u) for u in units]
        sizes = np.array([len(g) for g in guess], np.int64)
        flat = np.array([t for g in guess for t in g], np.int64)
        if len(flat) < 2:
            return guess
        owner = np.repeat(np.arange(len(guess)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        codes, of = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        known = [self.pairs.get(c) for c in codes.tolist()]
        new = np.array([i for i, v in enumerate(known) if v is None], np.int64)
        verdict = np.array([bool(v) for v in known])
        if len(new):
            verdict[new] = self._compatible(codes[new] // self.size, codes[new] % self.size)
            if len(self.pairs) < PAIRS_KEPT:
                self.pairs.update(zip(codes[new].tolist(), verdict[new].tolist(), strict=True))
        for i in np.unique(owner[inner[~verdict[of]]]).tolist():
            guess[i] = self._merged(units[i])
        return guess

    def _units(self, plain: str) -> list[str]:
        """Units of merging in a piece without special tokens."""
        if not plain.isascii():
            plain = unicodedata.normalize("NFC", plain).replace("Σ", "σ")
        units = []
        for found in self.pattern.findall(plain.lower()):
            raw = found.encode()
            units.append(raw[:-1].decode("latin-1") + chr(256 + raw[-1]))
        return units

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of blank-free pieces as little-endian unsigned 32-bit numbers."""
        numbers: dict[str, int] = {}
        plans = []
        for piece in pieces:
            plan: list[int] = []  # a unit's number, or -1 - id of a special token
            at = 0
            for found in self.special_pattern.finditer(piece) if "<" in piece else ():
                plan += [numbers.setdefault(u, len(numbers)) for u in self._units(piece[at:found.start()])]
                plan.append(-1 - self.specials[found[0]])
                at = found.end()
            plan += [numbers.setdefault(u, len(numbers)) for u in self._units(piece[at:] if at else piece)]
            plans.append(plan)
        ids = [np.array(x, "<u4").tobytes() for x in self._encode_units(list(numbers))]
        return [
            b"".join([ids[n] if n >= 0 else np.array([-1 - n], "<u4").tobytes() for n in plan]) for plan in plans
        ]

    @property
    def spaced_names(self) -> list[bytes]:
        """Each token's text with a blank before it."""
        if not hasattr(self, "_spaced"):
            self._spaced = [b" " + self.names.get(i, "").encode() for i in range(max(self.names) + 1)]
        return self._spaced

    def decode(self, ids: bytes) -> bytes:
        """Token texts joined by blanks, as the library does where no decoder is set."""
        names = self.spaced_names
        return b"".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def bpe_memo(path: str) -> Memo:
    return Memo(bpe(path).encode)


def encoded(texts: pa.Array, path: str) -> list[bytes]:
    """Ids of each text."""
    pieces, first = word_pieces(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    coded = pieces.dictionary_encode()
    return joined(bpe_memo(path).ids(coded.dictionary.to_pylist()), coded.indices.to_numpy(), first)


def _digests(path: str):
    """Turns a batch of texts into counts and digests of ids and decoded text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoded(batch["text"], path)
        decode = bpe(path).decode
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([sha256(x).hexdigest() for x in ids]),
                pa.array([sha256(decode(x)).hexdigest() for x in ids]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return work


def _coded(path: str, others: list[str]):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoded(batch["text"], path)
        decode = bpe(path).decode
        return pa.RecordBatch.from_arrays(
            [batch[n] for n in others]
            + [pa.array(ids, pa.binary()), pa.array([decode(x).decode("utf-8", "replace") for x in ids])],
            names=[*others, "ids", "decoded"],
        )

    return work


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes if n != "text") + ", ids binary, decoded string"
    return arrow_map(kept, _coded(path, list(keep)), schema)


def code_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; only digests leave the tasks."""
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(
        docs.select("doc_id", "text"), _digests(path),
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
