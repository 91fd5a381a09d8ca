"""Collocations by dynamic itemset counting of word sequences.

The texts are dealt into shards, which are scanned one after the other, round and round.
Words are counted from the start. A longer phrase becomes active as soon as both phrases one word
shorter inside it (all but its last, all but its first word) have reached the least count, is
counted from the next shard on, and is done after one full cycle of shards, so phrases
of all lengths are counted in the same scans.

A step counts one shard: tasks split their texts into words (Arrow), give equal words,
then equal phrases, equal numbers (numpy) and emit the active phrases with their counts. Spark adds
them up, and a phrase's count so far is the sum over the last ``shards`` steps: these
hold every shard once, so nothing is counted twice and a phrase active for a whole cycle has its
exact count. Phrases with the least count join the reached ones.

Tasks know the reached phrases as two bit tables of fixed size (``2 ** bits`` bits each: all
of them, and those reached within the last cycle), the only thing that is collected and broadcast.
A false hit only counts a phrase that need not be counted; its count is right or too small, never too
large, and phrases below the least count are dropped in the end.

Scores: every cut of a candidate joins the counts of its two parts; the rest is exact decimal
arithmetic of 38 digits (counts up to 10**12 words).

Defined cases: null texts are empty; a null language is ``und``; texts are read whole, and
split between pieces, never inside one, so one piece without a separator is held in memory
whole by its task; repeated rows count again; ties in ranks go by count and phrase; an empty
table gives no rows; further columns do not matter; each language has its own counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codehealth.llm.common import drop_path, shared_path, ship_package

# ---- fixed values: what ends a piece ----------------------------------------------------
SEPARATOR = "[.,;:!?\\x0A-\\x0D]"
# ----------------------------------------------------------------------------------------
ENDS = re.compile(SEPARATOR.encode())
END = "."  # stands for every separator; no word can be one
PLAIN = bytes(ord(END) if ENDS.match(bytes([c])) else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
BLOCK = 4 << 20  # bytes that a task counts at once
BLOCK_ROWS = 1 << 15  # bits of a bit table in one row
PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    least: int = 100
    longest: int = 5
    shards: int = 2
    bits: int = 26
    scale: int = 1000
    top: int = 2000


def shards(docs: DataFrame, path: str, n: int) -> DataFrame:
    """Write ``lang, text`` in ``n`` folders of about equal size, without a shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).write.partitionBy("shard").parquet(path, compression="zstd")
    return spark.read.schema("lang string, text string, shard int").parquet(path)


# ---- inside a task ----------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of about ``BLOCK`` bytes; a longer text is cut behind a separator."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
            text, at = text.as_py(), 0
            while at < len(text):
                end = len(text)
                if end - at > 2 * BLOCK and (cut := ENDS.search(text, at + BLOCK)):
                    end = cut.end()
                held.setdefault(lang, []).append(text[at:end])
                size[lang] = size.get(lang, 0) + end - at
                at = end
                if size[lang] >= BLOCK:
                    yield lang, held.pop(lang)
                    del size[lang]
                elif len(held) > 64:  # many languages: what is held stays bounded
                    for each in list(held):
                        yield each, held.pop(each)
                    size.clear()
    yield from held.items()


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and the numbers of the words in order; -1 ends a piece."""
    text = np.frombuffer(b".".join([*texts, b""]).translate(PLAIN).replace(b".", b" . "), np.uint8)
    shown = text != 0x20
    edges = np.flatnonzero(np.diff(shown.view(np.int8), prepend=0, append=0))
    offsets = np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    flat = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(text[shown]))
    coded = flat.dictionary_encode()
    numbers = np.arange(len(coded.dictionary), dtype=np.int32)
    numbers[pc.index(coded.dictionary, END).as_py()] = -1
    return coded.dictionary, numbers[coded.indices.to_numpy()]


def word_hashes(lang: str, words: pa.StringArray) -> np.ndarray:
    """A polynomial of each word's bytes, mixed with its language."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    sizes = np.diff(offsets)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(sizes.max(), PRIME, np.uint64), dtype=np.uint64)
        places = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        sums = np.add.reduceat((data + np.uint64(1)) * powers[places], offsets[:-1] - offsets[0])
        return (sums ^ (sums >> np.uint64(31))) * PRIME + np.uint64(xxhash.xxh64_intdigest(lang))


def longer(begun: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of phrases that go on with one more word."""
    with np.errstate(over="ignore"):
        return (begun ^ (begun >> np.uint64(29))) * PRIME + word


def spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes ^ (hashes >> np.uint64(32))) * PRIME >> np.uint64(64 - bits)).astype(np.int64)


def _held(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _distinct(codes: np.ndarray, at: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct phrase of ``k`` words, and its count."""
    keys, room = codes[at].astype(np.int64), size
    for i in range(1, k):
        if room > (1 << 62) // size:  # the numbers would not fit: count on with dense ones
            keys = np.unique(keys, return_inverse=True)[1]
            room = int(keys.max()) + 1
        keys, room = keys * size + codes[at + i], room * size
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return at[first], counts


def count_block(lang: str, texts: list[bytes], count_words: bool, reached: np.ndarray, recent: np.ndarray, p: Params) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, counts) of the active phrases of a block."""
    words, codes = words_of(texts)
    if count_words:
        counts = np.bincount(codes[codes >= 0], minlength=len(words))
        some = np.flatnonzero(counts)
        yield 1, words.take(pa.array(some)), counts[some]
    if not recent.any():
        return
    of_word = word_hashes(lang, words)
    places = spots(of_word, p.bits)
    # of each place: is the phrase of the present length that begins there reached, and lately; its hash
    ok, new, now = (np.append(x, x.dtype.type(0))[codes] for x in (_held(reached, places), _held(recent, places), of_word))
    of_place = now
    for k in range(2, p.longest + 1):
        at = np.flatnonzero(ok[:-1] & ok[1:])
        if not len(at):
            return
        fresh = at[new[at] | new[at + 1]]
        if len(fresh):
            begin, counts = _distinct(codes, fresh, k, len(words))
            columns = [words.take(pa.array(codes[begin + i])) for i in range(k)]
            yield k, pc.binary_join_element_wise(*columns, " "), counts
        if k == p.longest:
            return
        now_at = longer(now[at], of_place[at + k - 1])
        places, size = spots(now_at, p.bits), len(codes) - k + 1
        ok, new, now = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint64)
        ok[at], new[at], now[at] = _held(reached, places), _held(recent, places), now_at


def count_shard(rows: DataFrame, count_words: bool, tables, p: Params) -> DataFrame:
    """``lang, k, phrase, n`` of the active phrases of one shard, once for each block of texts."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, recent = tables.value
        for lang, texts in _blocks(batches):
            for k, phrases, counts in count_block(lang, texts, count_words, reached, recent, p):
                for at in range(0, len(counts), 50_000):
                    part, n = phrases.slice(at, 50_000), counts[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(np.full(len(n), k, np.int32)), part, pa.array(n)], schema=schema)
    return rows.select("lang", "text").mapInArrow(count, "lang string, k int, phrase string, n bigint")


def bit_table(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bit table of ``lang, phrase``: each task sets bits in one of its own, which are or-ed together by parts."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            langs, lengths = np.array(batch["lang"].to_pylist(), object), batch["k"].to_numpy()
            for lang in set(langs):
                for k in set(lengths[langs == lang].tolist()):
                    some = batch["phrase"].filter(pa.array((langs == lang) & (lengths == k)))
                    of_word = word_hashes(lang, pc.split_pattern(some, " ").flatten()).reshape(-1, k)
                    at = spots(reduce(longer, of_word.T), bits)
                    np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = table.reshape(-1, BLOCK_ROWS >> 3)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some])], ["part", "held"])

    def merge(group: pa.Table) -> pa.Table:
        held = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["held"].to_pylist()])
        return pa.table([group["part"].slice(0, 1), pa.array([held.tobytes()])], names=["part", "held"])

    out = np.zeros(1 << bits - 3, np.uint8).reshape(-1, BLOCK_ROWS >> 3)
    parts = phrases.select("lang", "k", "phrase").coalesce(8).mapInArrow(place, "part bigint, held binary")
    for row in parts.groupBy("part").applyInArrow(merge, "part bigint, held binary").collect():  # 2 ** bits bits at most
        out[row["part"]] = np.frombuffer(row["held"], np.uint8)
    return out.reshape(-1)


# ---- the rounds ---------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, n`` of all phrases with the least count, and ``lang, total`` words."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = shared_path(spark, "itemsets")
    texts = shards(docs, f"{folder}/texts", p.shards)
    counted = "lang string, k int, phrase string, n bigint"

    def stored(name: str, steps) -> DataFrame:
        return spark.read.schema(counted).parquet(*[f"{folder}/{name}/{i}" for i in steps])

    none = np.zeros(1 << p.bits - 3, np.uint8)
    reached, latest = none, [none]  # bits of all reached phrases, and of those of each step of the last cycle
    step, key = 0, ["lang", "k", "phrase"]
    while step < p.shards or any(table.any() for table in latest):
        sent = spark.sparkContext.broadcast((reached, np.bitwise_or.reduce(latest)))
        shard = texts.where(F.col("shard") == step % p.shards)
        # one shuffle adds up this shard and joins what the cycle's other shards had
        cycle = count_shard(shard, step < p.shards, sent, p).withColumn("before", F.lit(0).cast("bigint"))
        if earlier := range(max(0, step - p.shards + 1), step):
            cycle = cycle.unionByName(stored("counts", earlier).select(*key, F.lit(0).cast("bigint").alias("n"), F.col("n").alias("before")))
        cycle = cycle.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("before").alias("before")).where("n > 0")
        cycle.select(*key, "n", (F.col("n") + F.col("before")).alias("all")).write.parquet(f"{folder}/counts/{step}", compression="zstd")
        sent.destroy()
        done = spark.read.schema(f"{counted}, all bigint").parquet(f"{folder}/counts/{step}")
        done.where(F.col("all") >= p.least).select(*key, F.col("all").alias("n")).write.parquet(f"{folder}/frequent/{step}")
        if step < p.shards:
            done.where("k = 1").groupBy("lang").agg(F.sum("n").alias("total")).write.parquet(f"{folder}/totals/{step}")
        if step >= p.shards - 1:
            drop_path(spark, f"{folder}/counts/{step - p.shards + 1}")
        now = stored("frequent", [step])
        if step:
            now = now.join(stored("reached", range(step)).select(*key), key, "left_anti")
        now.write.parquet(f"{folder}/reached/{step}")
        new = bit_table(stored("reached", [step]).where(F.col("k") < p.longest), p.bits)
        reached, latest, step = reached | new, [*latest, new][-p.shards:], step + 1
    # a phrase's count is whole in the last step of its cycle and never larger in another
    stored("frequent", range(step)).groupBy(*key).agg(F.max("n").alias("n")).write.parquet(f"{folder}/phrases")
    for name in ("texts", "counts", "frequent", "reached"):
        drop_path(spark, f"{folder}/{name}")
    totals = spark.read.schema("lang string, total bigint").parquet(*[f"{folder}/totals/{i}" for i in range(p.shards)])
    return spark.read.schema(counted).parquet(f"{folder}/phrases"), totals.groupBy("lang").agg(F.sum("total").alias("total"))


def collocations(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    A cut's score is floor(scale * a * n / (l * r)); the lowest cut counts, the shortest first part among equals.
    A phrase is left out if a longer one that holds it is as frequent.
    """
    phrases, totals = frequent_phrases(docs, p)
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    words = F.split("phrase", " ")
    long = phrases.where("k > 1").withColumn("w", words)
    join = lambda w, at, n: F.array_join(F.slice(w, at, n), " ")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: join(F.col("w"), i, n))))
    inside = long.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("more"))
    kept = long.join(inside, ["lang", "phrase"], "left").where("more is null or more < n").drop("more")

    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.col("w"), F.lit(1), F.col("cut")).alias("left"), join(F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("m").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("m").alias("r")), ["lang", "right"]).join(totals, "lang")
    digits = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(p.scale).cast("decimal(4,0)") * (digits("a") * digits("total")).cast("decimal(33,0)"), (digits("l") * digits("r")).cast("decimal(36,0)"))
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", F.col("total").alias("n"))).alias("b")).select("lang", "phrase", "b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= p.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
