"""SimHash near-duplicates by the pigeonhole principle on blocks.

A fingerprint is cut into ``blocks`` blocks. Two fingerprints that differ in at most
``max_bits`` bits agree in at least ``blocks - max_bits`` of them, so every choice of
that many blocks is a join key; pairs that share a key are verified by Hamming
distance. Equal fingerprints are one node throughout.

A key that more than ``bucket`` fingerprints share is handled without pairs (for
``max_bits`` 2): its fingerprints emit themselves and all their one-bit changes, and
two fingerprints that emit one value are at most two bits apart, while all that are
as close emit one. The groups of a value hold at most 65 fingerprints, and their
first one is linked to the others.

Defined cases: a null text has no words; no words give fingerprint zero, linked like
any other; fewer words than a shingle make one shingle; null ids take no part in
links (their component is null) but keep their rows; rows with equal ids are one
document for components; texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import saved, ship_package
from codehealth.llm.graph import components

SEED = 42


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    max_bits: int = 2
    blocks: int = 4
    bucket: int = 16

    def __post_init__(self):
        assert 64 % self.blocks == 0 and self.max_bits < self.blocks
        assert self.max_bits <= 2, "large buckets are split for two bits at most"


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and white space as in the contract
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1:].tolist(), strict=True)),
                         dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    ship_package()

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x, shingle) for x in batch], dtype="int64")
    return fingerprints(text)


def links(fingerprints: DataFrame, p: Params) -> DataFrame:
    """Edges ``a, b`` between distinct values of ``fp`` that join all which are close enough."""
    width = 64 // p.blocks
    block = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(p.blocks)]
    keys = []
    for n, choice in enumerate(combinations(range(p.blocks), p.blocks - p.max_bits)):
        # blocks side by side in one long
        packed = block[choice[0]]
        for c in choice[1:]:
            packed = F.shiftleft(packed, width).bitwiseOR(block[c])
        keys.append(F.struct(F.lit(n).alias("choice"), packed.alias("key")))
    rows = fingerprints.select("fp", F.inline(F.array(*keys)))
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = saved(rows.join(sizes, ["choice", "key"]))
    few = rows.where(F.col("n") <= p.bucket)
    left, right = few.select("choice", "key", F.col("fp").alias("a")), few.select("choice", "key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= p.max_bits)
    found = left.join(right, (left["choice"] == right["choice"]) & (left["key"] == right["key"]) & close).select("a", "b")
    many = rows.where(F.col("n") > p.bucket).select("fp").distinct()
    changes = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64 if p.max_bits else 0)])
    near = many.select("fp", F.explode(changes).alias("change")).select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("value"))
    groups = near.groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = groups.select("a", F.explode("fps").alias("b")).where("a != b")
    if p.max_bits < 2:  # values in common prove two bits, not one
        stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= p.max_bits)
    return found.union(stars).distinct()


def near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the component is named by its smallest document id."""
    rows = saved(docs.select("doc_id", fingerprint_column(F.col(text), p.shingle).alias("fp")))
    known = rows.where("doc_id is not null")
    nodes = saved(known.groupBy("fp").agg(F.min("doc_id").alias("first")))
    a, b = nodes.toDF("a", "node_a"), nodes.toDF("b", "node_b")
    near = links(nodes.select("fp"), p).join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    # a document with several rows joins their fingerprints
    several = known.groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select("doc_id")
    own = known.join(several, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    of = components(near.union(own))
    named = nodes.join(of, nodes["first"] == of["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
