"""Token ids in ORC files that can be read by stripe and pruned by metadata.

Documents are range-partitioned and sorted by id, tokenised, and written as ORC:
the ids of a document are one integer list, which ORC run-length encodes; row
indexes and stripe statistics cover the ascending document ids, and a Bloom
filter on them lets a look-up skip stripes and row groups. Spark splits the files
by stripe, so readers work side by side.

Defined cases: a null text counts as empty and holds the end id alone; a null
document id sorts first; rows with equal ids come in the order of their texts' hashes and may lie in several files;
texts are tokenised whole; an empty table writes files without rows; further
columns of the input are not stored.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from codehealth.llm.common import saved, ship_package

MEMO_ENTRIES = 250_000
MEMO_CHARS = 32  # longer pieces, as in text without blanks, are encoded each time
GROUP_BYTES = 2 * 1024 * 1024  # of texts that are encoded before their ids go back; a longer text is a group of its own
ROW_BITS = 33  # monotonically_increasing_id counts rows of a partition in the low 33 bits

LATIN_END = "\u0250"
GROWS = "\u0130"  # the one letter that lower-casing makes longer

# Classes of bytes. An apostrophe may begin a token with letters, and < or | belong to special tokens, so they are OTHER.
BLANKS, MARKS = " \n", "!\"#$%&()*+,./:;=?@[]^`{}~-"
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
KINDS = {BLANK: BLANKS, LETTER: string.ascii_letters, DIGIT: string.digits, MARK: MARKS}
LOWER = bytes(range(256)).lower()
CLASS = bytes(next((kind for kind, chars in KINDS.items() if chr(b) in chars), OTHER) for b in range(256))
# whether a text may be cut between two bytes of these classes: no token lies across, and each side has the ids it has alone
CUTS = {(BLANK, LETTER), (BLANK, DIGIT), (BLANK, MARK), (BLANK, OTHER), (LETTER, DIGIT), (LETTER, MARK), (MARK, LETTER), (MARK, DIGIT),
        (DIGIT, LETTER), (DIGIT, DIGIT), (DIGIT, MARK)}
CUT = bytes((pair >> 3, pair & 7) in CUTS for pair in range(256))

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 * 1024 * 1024),
    "compression": "zstd",
}


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a letter from U+00C0 to U+023F are LETTER."""
    classes = np.frombuffer(bytearray(data.tobytes().translate(CLASS)), np.uint8)
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    first, second = data[lead], data[lead + 1]
    lead = lead[(first != 0xC3) | (second != 0x97) & (second != 0xB7)]  # the signs of multiplication and division
    classes[lead] = classes[lead + 1] = LETTER
    return classes


def _starts(classes: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte but the first."""
    pairs = classes.copy()
    pairs[1:] |= classes[:-1] << 3
    return np.frombuffer(bytearray(pairs.tobytes().translate(CUT)), bool)


def _strings(texts: pa.LargeStringArray) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _depends_on_next(text: str) -> bool:
    """The library's ids of a part of this text may depend on what comes next."""
    return not text.isascii() and (GROWS in text or not unicodedata.is_normalized("NFC", text))


class _Words:
    """Ids of texts, put together from those of their pieces, each tokenised once by the library.

    The tokenizer drops white space and never lets a token cross it, nor the border of
    letters, digits and most marks, so the ids of a text are those of its pieces in order.
    Short pieces are remembered with their ids; of too many, those used last stay.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content.encode().translate(LOWER) for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens that end a word
        self.closes[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.known = pa.array([], pa.large_string())
        self.sizes, self.used, self.flat, self.groups = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<i4"), 0

    @property
    def ids(self) -> dict[str, bytes]:
        """The pieces that are remembered."""
        ends = np.cumsum(self.sizes)
        return {x: self.flat[end - n:end].tobytes() for x, n, end in zip(_strings(self.known), self.sizes, ends, strict=True)}

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.large_string()))[1].tobytes()

    def encode_all(self, texts: pa.LargeStringArray, end: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin (and the last one's end), and all ids; ``end`` follows each text."""
        texts = texts.fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        firsts, pieces = self._pieces(texts, bounds, data)
        at, sizes, flat = self._encode(pieces.dictionary)
        at, sizes, flat = np.append(at, len(sizes)), np.append(sizes, len(end)), np.append(flat, np.array(end, "<i4"))
        which = at[np.insert(pieces.indices.to_numpy(), firsts[1:], len(at) - 1)]
        froms, counts = np.cumsum(sizes) - sizes, sizes[which]
        till = np.cumsum(counts)
        places = np.repeat(froms[which] - till + counts, counts) + np.arange(counts.sum())
        return np.append(0, till)[firsts + np.arange(len(firsts))], flat[places]

    def _pieces(self, texts: pa.LargeStringArray, bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The pieces of all texts in order, without blanks and A-Z, and the number of pieces before each text and in all."""
        classes = _classes(data)
        starts, kept = _starts(classes), classes != BLANK
        if len(data) and data.max() > 0x7F:
            for i in (i for i, x in enumerate(_strings(texts)) if _depends_on_next(x)):  # one piece
                starts[bounds[i]:bounds[i + 1]], kept[bounds[i]:bounds[i + 1]] = False, True
                classes[bounds[i]:bounds[i + 1]] = OTHER
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(starts)
        lower = data.tobytes().translate(LOWER)
        if not any(x in lower for x in self.specials):  # these count as they are written
            lower = np.frombuffer(bytearray(lower), np.uint8)
            after = np.flatnonzero(classes[1:] == OTHER)  # before a combining mark a letter stays: some pairs are one character if small
            after = after[data[after + 1] > 0x7F]
            lower[after] = data[after]
            data = np.where(classes == LETTER, lower, data)
        offsets = np.append(0, np.cumsum(np.add.reduceat(kept, starts, dtype=np.int64)))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
        return np.searchsorted(starts, bounds), pieces.dictionary_encode()

    def _encode(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of these different pieces its place in two arrays: numbers of ids, and the ids one after another."""
        found = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(found.is_null())
        order, sizes, flat = self._encode_new(_strings(new))
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        self.groups += 1
        self.used[at[at >= 0]] = self.groups
        places = np.empty(len(new), np.int64)
        places[order] = len(self.sizes) + np.arange(len(new))
        at[at < 0] = places
        out = at, np.append(self.sizes, sizes), np.append(self.flat, flat)
        self._remember(new.take(pa.array(order)), *out[1:])
        return out

    def _remember(self, new: pa.LargeStringArray, sizes: np.ndarray, flat: np.ndarray) -> None:
        known, used = pa.concat_arrays([self.known, new]), np.append(self.used, np.full(len(new), self.groups))
        stay = pc.less_equal(pc.utf8_length(known), MEMO_CHARS).to_numpy(zero_copy_only=False)
        if stay.sum() > 2 * MEMO_ENTRIES:
            stay[np.argsort(np.where(stay, used, -1), kind="stable")[:-MEMO_ENTRIES]] = False
        self.known, self.sizes, self.used, self.flat = known.filter(pa.array(stay)), sizes[stay], used[stay], flat[np.repeat(stay, sizes)]

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of these pieces, and in it their numbers of ids and their ids.

        One call of the library encodes all words of letters, as each ends with the one token that closes it.
        """
        plain = np.array([x.isalpha() and (x.isascii() or max(x) < LATIN_END and GROWS not in x) for x in pieces], bool)
        words, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        joined = self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in words])], add_special_tokens=False)[0].ids if len(words) else []
        flat = np.array(joined, "<i4")
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):  # the vocabulary marks no ends
            words, rest, flat, ends = words[:0], np.arange(len(pieces)), flat[:0], ends[:0]
        others = [self._library(pieces[i]) for i in rest]
        sizes = np.append(np.diff(ends, prepend=0), np.array([len(x) // 4 for x in others], np.int64))
        return np.append(words, rest), sizes, np.append(flat, np.frombuffer(b"".join(others), "<i4"))

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()


@lru_cache(maxsize=2)
def _words(spec: str) -> _Words:
    return _Words(spec)


def _groups(texts: pa.LargeStringArray) -> Iterator[pa.LargeStringArray]:
    """Neighbouring texts of ``GROUP_BYTES`` in all, or one that is longer."""
    if len(texts):
        bounds, at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1], 0
        while at < len(texts):
            till = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP_BYTES, side="right")) - 1)
            yield texts.slice(at, till - at)
            at = till


def ids_column(text: Column, spec: str, end_id: int) -> Column:
    ship_package()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _words(spec)
        for group in (g for b in batches for g in _groups(b.cast(pa.large_string()))):
            offsets, flat = words.encode_all(group, [end_id])
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
    return ids(text)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Write ``doc_id``, ``seq`` (ascending in file order) and ``ids`` as ORC below ``path``."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    rows = docs.select("doc_id", "text")
    rows = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("seq"), ids_column(F.col("text"), spec, end_id).alias("ids"))
    rows.write.options(**ORC_OPTIONS).mode("errorifexists").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; ``doc_ids`` are pushed down to stripe statistics, row indexes and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


@F.arrow_udf(LongType())
def _crc32(ids: pa.Array) -> pa.Array:
    flat, offsets = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.diff(ids.offsets.to_numpy())
    ends = np.cumsum(offsets)
    return pa.array([zlib.crc32(flat[e - n:e].tobytes()) for n, e in zip(offsets, ends, strict=True)], pa.int64())


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document.

    ``start`` counts the ids of all documents before it: totals of the written
    partitions are summed up in their order, and each adds a running sum of its own.
    """
    ship_package(spark)
    rows = read_tokens(spark, path).select("doc_id", "seq", F.size("ids").cast("long").alias("n_tokens"), _crc32("ids").alias("ids_crc32"))
    rows = saved(rows.withColumn("part", F.shiftright("seq", ROW_BITS)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each written partition
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "part")
            .select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"))
