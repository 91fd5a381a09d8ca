"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts become words; every run of ``gram`` words is hashed. Of every ``window -
gram + 1`` grams that follow each other the smallest hash is a fingerprint, so any
``window`` words that two texts share have a fingerprint in common. Fingerprints of
documents and items are joined. In documents with a hit, every gram that equals an
item's fingerprint is extended word by word to both sides; if ``window`` words or
more agree, they are hit. Items of fewer words than ``window`` are one gram and are
looked up whole.

Broadcast: the items' fingerprints and the documents with hits are counted first and
are broadcast up to ``broadcast_rows`` rows; beyond, the same joins shuffle.

Defined cases: null texts have no words; documents without words are not hit; items
without words occur nowhere; rows that agree in id and text keep their rows and have
the same result; item ids count once each, as strings; words of any length and texts
of any length are used whole; an empty table on either side gives no hits; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words, once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Params:
    window: int = 10
    gram: int = 5
    broadcast_rows: int = 200_000

    @property
    def beside(self) -> int:
        return self.window - self.gram


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def _shifted(array: Column, first: int, short: int) -> Column:
    """``short`` elements fewer, from place ``first``."""
    return F.slice(array, F.lit(first), F.greatest(F.size(array) - short, F.lit(0)))


def _fold(rows: DataFrame, source: str, out: str, span: int, join) -> DataFrame:
    """Combine every ``span`` neighbours of an array, doubling what is combined step by step."""
    have, name = 1, source
    while have < span:
        step = min(have, span - have)
        made = f"{out}_{have + step}"
        # runs of `have` and runs of `have` that begin `step` later make runs of have + step
        rows = rows.withColumn(made, F.zip_with(_shifted(F.col(name), 1, step), _shifted(F.col(name), 1 + step, step), join))
        have, name = have + step, made
    return rows.withColumnRenamed(name, out) if name != source else rows.withColumn(out, F.col(source))


def grams(rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` with ``words`` get ``grams``: the hash of every run of ``gram`` words."""
    rows = rows.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    keep = [*rows.columns, "grams"]
    return _fold(rows, "__h", "grams", p.gram, lambda x, y: F.xxhash64(x, y)).select(*keep).drop("__h")


def winnowed(rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` with ``grams`` get ``picked``: the smallest hash of every run of grams in a window."""
    keep = [*rows.columns, "picked"]
    return _fold(rows, "grams", "picked", p.beside + 1, lambda x, y: F.least(x, y)).select(*keep)


def _sides(p: Params, at: Column) -> tuple[Column, Column]:
    """Words before place ``at`` (from 0), nearest last, and words from it on."""
    left = F.slice("words", F.greatest(at - p.beside, F.lit(0)) + 1, F.least(at, F.lit(p.beside)))
    return left, F.slice("words", at + 1, F.lit(p.window))


def _agree(p: Params, a: str, b: str, backwards: bool) -> Column:
    """How many words agree one after the other, from the start or from the end."""
    most = p.beside if backwards else p.window
    if not most:
        return F.lit(0)
    same = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.coalesce(
        F.try_element_at(a, -i if backwards else i) == F.try_element_at(b, -i if backwards else i), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.lit(most))


def _runs(length: int) -> Column:
    """Every run of so many words: its place, length and text."""
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda at: F.struct(
        at.alias("at"), F.lit(length).alias("length"), F.array_join(F.slice("words", at + 1, F.lit(length)), " ").alias("run")))
    return F.when(F.size("words") >= length, runs).otherwise(F.array().cast("array<struct<at:int,length:int,run:string>>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what has been counted as small."""
    return F.broadcast(df) if df.count() <= rows else df


def hits(docs: DataFrame, items: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Per distinct document (``doc_id``, ``hash``): rows and words; and its hits (``item_id``, ``first``, ``last`` word)."""
    items = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    long_items = winnowed(grams(items.where(F.size("words") >= p.window), p), p)
    # every place of an item where one of its fingerprints stands, with the words around it
    spots = long_items.select("item_id", "words", "picked", F.posexplode("grams").alias("at", "gram"))
    left, right = _sides(p, F.col("at"))
    spots = saved(spots.where(F.array_contains("picked", F.col("gram")))
                  .select("item_id", "gram", left.alias("item_left"), right.alias("item_right")))
    marks = _small(saved(spots.select(F.col("gram").alias("mark")).distinct()), p.broadcast_rows)

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), words(F.col("text")).alias("words"))
    prints = winnowed(grams(rows, p), p).select("doc_id", "hash", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("picked").alias("at", "mark_"))
    per_doc = (prints.join(marks, F.col("mark_") == F.col("mark"), "left").groupBy("doc_id", "hash")
               .agg(F.max("n_words").alias("n_words"), F.count("mark").alias("marks"),
                    F.sum(F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, 1).otherwise(0)).alias("copies")))
    per_doc = saved(per_doc)

    chosen = _small(saved(per_doc.where("marks > 0").select(F.col("doc_id").alias("c_id"), F.col("hash").alias("c_hash"))), p.broadcast_rows)
    some = docs.withColumn("__hash", F.xxhash64("text")).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("__hash") == F.col("c_hash")), "left_semi")
    some = grams(some.select("doc_id", F.col("__hash").alias("hash"), words(F.col("text")).alias("words")), p)
    left, right = _sides(p, F.col("at"))
    at_grams = F.transform("grams", lambda g, at: F.struct(at.alias("at"), g.alias("gram"), *[
        side.alias(name) for side, name in zip(_sides(p, at), ("left", "right"), strict=True)]))
    at_grams = some.select("doc_id", "hash", F.inline(at_grams))
    met = at_grams.join(_small(spots, p.broadcast_rows), "gram")
    met = met.select("doc_id", "hash", "item_id", "at", _agree(p, "left", "item_left", True).alias("before"), _agree(p, "right", "item_right", False).alias("after"))
    met = met.where((F.col("after") >= p.gram) & (F.col("before") + F.col("after") >= p.window))
    found = met.select("doc_id", "hash", "item_id", (F.col("at") - F.col("before")).cast("long").alias("first"),
                       (F.col("at") + F.col("after") - 1).cast("long").alias("last"))

    short = saved(items.where(F.size("words") < p.window).select("item_id", F.size("words").alias("length"), F.array_join("words", " ").alias("run")))
    lengths = sorted(r[0] for r in short.select("length").distinct().collect())  # at most window - 1 numbers
    if lengths:
        short_rows = rows.select("doc_id", "hash", F.inline(F.flatten(F.array(*[_runs(n) for n in lengths]))))
        more = short_rows.join(_small(short, p.broadcast_rows), ["length", "run"])
        found = found.union(more.select("doc_id", "hash", "item_id", F.col("at").cast("long"), (F.col("at") + F.col("length") - 1).cast("long")))
    return per_doc, saved(found.distinct())


def decontaminate(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, hash, n_words, n_hit, n_items, items, contaminated`` of every row (``items``: sorted ids as strings)."""
    per_doc, found = hits(docs, items, p)
    spans = found.select("doc_id", "hash", "first", "last").distinct()
    n_hit = spans.select("doc_id", "hash", F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy("doc_id", "hash").agg(F.count("*").alias("n_hit"))
    ids = found.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = n_hit.withColumnsRenamed({"doc_id": "h_id", "hash": "h_hash"}).join(
        ids, F.col("h_id").eqNullSafe(F.col("doc_id")) & (F.col("h_hash") == F.col("hash"))).select("h_id", "h_hash", "n_hit", "items")
    out = per_doc.join(both, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("hash") == F.col("h_hash")), "left")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    items_ = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "hash", "n_words", F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
                      F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
