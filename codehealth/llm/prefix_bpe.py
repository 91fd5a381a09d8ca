"""Byte-level BPE by dynamic programming over prefixes.

BPE gives every prefix of a piece of text exactly one encoding, and cutting the
last token off the encoding of a prefix leaves the encoding of the shorter
prefix. So one token id for each prefix length, its last token, stores the
encodings of all prefixes. An automaton over the vocabulary lists the tokens
that are suffixes of each prefix; the last token is the one of them that is
compatible with the last token of the prefix before it, where two tokens are
compatible if merging their joint bytes gives the same two tokens back.
Following the last tokens from the end emits the ids.

Defined cases: a null text counts as empty; an empty text has no ids; the
special token's string in a text becomes its id, as in the library's default;
texts of any length are encoded whole; repeated rows give repeated results; an
empty table gives an empty result; columns of the input that are not named stay
untouched (a column named like an output column is replaced).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import Memo, ship_package

#: Fixed value: the split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_ENTRIES = 250_000
MEMO_CHARS = 32  # longer ones, as in text without blanks, are encoded each time
ROWS = 256  # texts that are encoded before their ids go back
_TOKEN_BITS = 32
_NEVER = math.inf


class _Irregular(Exception):
    """A blank is followed by white space or by the end."""


def byte_of_symbol() -> dict[str, int]:
    """The vocabulary file's printable symbol for each byte: itself if it is visible, else from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixBpe:
    """Encoder and decoder for one vocabulary (the text of its JSON file)."""

    def __init__(self, spec: str):
        import ahocorasick

        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        symbol = byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: bytes(symbol[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.halves: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            self.rank[a, b] = rank
            self.halves.setdefault(vocab[left + right], (a, b, rank))
        self.suffixes = ahocorasick.Automaton()
        for s, i in vocab.items():
            if s not in self.special:
                self.suffixes.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.edges = lru_cache(maxsize=None)(self._edges)  # two entries a token at most
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.fits = Memo(self._compatible, MEMO_ENTRIES)
        self.piece_ids = Memo(self._encode_piece, MEMO_ENTRIES // 5, MEMO_CHARS)
        self.after_blank = Memo(self._encode_after_blank, MEMO_ENTRIES, MEMO_CHARS)

    def _edges(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """What stands at one edge (0 left, 1 right) of a token while it is merged, each with the rank that ends it."""
        if token not in self.halves:
            return ((token, _NEVER),)
        part, rank = self.halves[token][side], self.halves[token][2]
        return (*self.edges(part, side)[:-1], (part, rank), (token, _NEVER))

    def _compatible(self, pair: int) -> bool:
        """No merge crosses the border of the two tokens (first one in the high bits) while both are built up."""
        left, right = self.edges(pair >> _TOKEN_BITS, 1), self.edges(pair & (1 << _TOKEN_BITS) - 1, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.rank.get((x, y), _NEVER)
            if across < x_ends and across <= y_ends:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode().decode("latin-1")
        last = [-1] * len(data)  # of each prefix, by the place where it ends
        fits, length = self.fits, self.length
        for end, token in self.suffixes.iter(data):
            if last[end] < 0:
                before = end - length[token]
                if before < 0 or fits[last[before] << _TOKEN_BITS | token]:
                    last[end] = token
        ids, at = [], len(data) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        return b"".join([i.to_bytes(4, "little") for i in reversed(ids)])

    def _encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.pieces.findall(chunk)))

    def _encode_after_blank(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one piece
            return self._encode_piece(" " + chunk)
        if not chunk or chunk[0].isspace():
            raise _Irregular
        if chunk[-1] in ".," and chunk[:-1].isalpha():  # two
            return self.after_blank[chunk[:-1]] + self.piece_ids[chunk[-1]]
        return self._encode_chunk(" " + chunk)

    def _encode_plain(self, text: str) -> bytes:
        """A text without special tokens, cut before every blank that a non-blank follows: no piece crosses these."""
        first, *rest = text.split(" ")
        try:
            return self._encode_chunk(first) + b"".join(map(self.after_blank.__getitem__, rest))
        except _Irregular:
            chunks = [first]
            for x in rest:
                if not x or x[0].isspace():
                    chunks[-1] += " " + x
                else:
                    chunks.append(" " + x)
            return b"".join(map(self._encode_chunk, chunks))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._encode_plain(text[at:m.start()]) if m.start() > at else b"",
                    np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:]) if at < len(text) else b""])

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _coder(spec: str) -> PrefixBpe:
    return PrefixBpe(spec)


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches cut small, so that what is made of one at a time is bounded."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def encode_column(text: Column, spec: str) -> Column:
    """Ids of a text column as binary (little-endian unsigned 32-bit integers)."""
    ship_package()

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(spec)
        for part in _parts(batches):
            yield pa.array(map(coder.encode, part.to_pylist()), pa.binary())
    return encoded(text)


def decode_column(ids: Column, spec: str) -> Column:
    """Text of a column of ids as made by :func:`encode_column`."""
    ship_package()

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(spec)
        for part in _parts(batches):
            yield pa.array(map(coder.decode, part.to_pylist()), pa.string())
    return decoded(ids)


def round_trip_column(text: Column, spec: str) -> Column:
    """Struct of ``ids`` and of their ``decoded`` text, in one pass."""
    ship_package()

    @F.arrow_udf("ids binary, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(spec)
        for part in _parts(batches):
            ids = [coder.encode(x) for x in part.to_pylist()]
            texts = map(coder.decode, ids)
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["ids", "decoded"])
    return both(text)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_and_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary) and ``decoded`` (string); no shuffle, one pass."""
    spec = read_spec(vocabulary)
    out = docs.withColumn("__both", round_trip_column(F.col(text), spec))
    return out.withColumns({"ids": F.col("__both.ids"), "decoded": F.col("__both.decoded")}).drop("__both")
