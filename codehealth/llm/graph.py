"""Connected components of large undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest member) for every node of ``edges`` (``a``, ``b``).

    Two steps take turns until nothing changes: every node hands its smallest
    neighbour to the larger ones, then to the smaller ones. Stars replace the edges, so
    the number of rows never grows beyond that of the edges; each round is saved.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now, seen = saved(ordered(edges)), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = least(both).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(small, "u").select(F.col("w").alias("a"), F.col("m").alias("b"))
        large = ordered(large)
        small = least(large)
        star = large.join(small, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        star = star.union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = saved(ordered(star))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
