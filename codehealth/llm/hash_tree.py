"""Sharding by a weighted hash tree of regions, racks and shards.

Every document draws a waiting time at every shard: -ln(u) / weight, where u is a
hash of document id and shard id. A rack's draw is the earliest of its shards', a
region's the earliest of its racks'; such a minimum is distributed like one draw
with the sum of the weights below it, so each level is a weighted hash draw. The
document descends to the region, the rack and the shard with the earliest draw.
Draws belong to shards and never change with their neighbours: if weights change,
only documents that enter or leave the changed subtrees move, and a new shard
takes rows only into itself.

Law: ``key`` - document id and shard count decide.

Defined cases: a null text has no bytes (size 16, crc32 of nothing); null ids all
draw alike and share a shard; rows with equal ids share a shard and get slots of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codehealth.llm.common import saved

ROW_BITS = 33  # monotonically_increasing_id counts rows of a partition in the low 33 bits
OVERHEAD = 16


@dataclass(frozen=True)
class Tree:
    """Shards 0 .. n-1, so many to a rack and racks to a region, with weights (1 unless given)."""

    shards: int
    shards_per_rack: int = 5
    racks_per_region: int = 4
    weights: tuple[tuple[int, float], ...] = ()

    def regions(self) -> list[list[list[int]]]:
        racks = [list(range(self.shards))[i:i + self.shards_per_rack] for i in range(0, self.shards, self.shards_per_rack)]
        return [racks[i:i + self.racks_per_region] for i in range(0, len(racks), self.racks_per_region)]


def _draw(key: Column, shard: int, weight: float) -> Column:
    """Waiting time at a shard; u lies in (0, 1), 53 bits of the hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / F.lit(float(weight))


def _first(draws: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The earliest draw of a level, and what lies below it."""
    least = F.least(*[d for d, _ in draws]) if len(draws) > 1 else draws[0][0]
    chosen = draws[-1][1]
    for draw, below in reversed(draws[:-1]):
        chosen = F.when(draw == least, below).otherwise(chosen)
    return least, chosen


def assign(docs: DataFrame, key: str, out: str, tree: Tree) -> DataFrame:
    """Add the shard of each row; draws are columns of their own, so that each is computed once."""
    weight = dict(tree.weights)
    of = lambda s: F.col(f"`__draw{s}`")
    rows = docs.select("*", *[_draw(F.col(key), s, weight.get(s, 1.0)).alias(f"__draw{s}") for s in range(tree.shards)])
    regions = [[_first([(of(s), F.lit(s)) for s in rack]) for rack in region] for region in tree.regions()]
    rows = rows.select("*", _first([_first(region) for region in regions])[1].alias(out))
    return rows.drop(*[f"__draw{s}" for s in range(tree.shards)])


def shard(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    Slots are gapless: rows are sorted by shard over all partitions, and a row's
    slot is its place in its partition plus the shard's rows in partitions before.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = assign(assign(rows, "doc_id", "shard", tree), "doc_id", "grown_shard", grown)
    rows = rows.repartitionByRange("shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32")
    rows = saved(rows.withColumn("seq", F.monotonically_increasing_id())).withColumn("part", F.shiftright("seq", ROW_BITS))
    runs = rows.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("seq").alias("first"))  # a row for each partition and shard in it
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "shard", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(runs), ["part", "shard"]).select(  # as many rows as partitions and shards, at most
        "doc_id", (F.col("bytes") + OVERHEAD).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("seq") - F.col("first")).alias("slot"), "grown_shard")
