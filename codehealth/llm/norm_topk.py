"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length, and each bucket into blocks of a
bounded number of rows. Every query first meets the longest vectors, which gives it a
lower bound for its k-th score. For each block that bound, over the lengths of query
and block, is a local threshold on the cosine:

- above 1 nothing in the block can reach it, and the block is passed over;
- from ``steep`` on, coordinate pruning: for the query's largest coordinates, a vector's
  share of them must lie in a feasible interval;
- else length pruning: a block is sorted by length, and vectors that are too short for
  the bound are left out.

What is left is verified by its products, in exact integers. Queries meet buckets in
blocks: a block of queries and a block of vectors make one task's group.

Defined cases: null vectors, and vectors with null or non-finite components, take no
part; vectors of different dimension are not compared; rows with a query's id are its
own and no candidates of it; rows that are equal in id and vector count once; fewer
candidates than k give all; ties go to the smaller id; scores beyond 64 bits are held
at the limits; a null id takes no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codehealth.llm.common import saved, ship_package

RESULT = "query_id bigint, vec_id bigint, score bigint"
EXACT = float(1 << 53)  # integers up to here are exact as doubles
LIMIT = (1 << 63) - 1


@dataclass(frozen=True)
class Params:
    k: int = 5
    ratio: float = 0.9  # lengths in a bucket lie within this factor
    block: int = 2048  # vectors of a block
    queries: int = 1024  # queries of a block
    first: int = 1024  # about so many of the longest vectors give the first bounds
    steep: float = 0.85  # cosine from which coordinates prune
    focus: int = 4  # coordinates used


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = pa.chunked_array(table.column(column).chunks).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as exact integers."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in v], dtype=object).T
    return np.vectorize(lambda x: max(-LIMIT - 1, min(LIMIT, x)), otypes=[np.int64])(whole)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_block(q_ids, q, bound, v_ids, v, p: Params) -> list[tuple[int, int, int]]:
    """Each query's best of one block: (query id, vector id, score). ``bound`` is -inf where unknown."""
    v_len = np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-v_len, kind="stable")
    v_ids, v, v_len = v_ids[order], v[order], v_len[order]
    q_len = np.sqrt((q * q).sum(axis=1))
    slack = 1 + 1e-9
    longest = v_len[0] if len(v_len) else 0.0
    out: list[tuple[int, int, int]] = []

    def take(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        other = v_ids[at] != q_ids[i]
        at, scores = at[other], scores[other]
        good = scores >= bound[i]
        at, scores = at[good], scores[good]
        best = _best(scores, v_ids[at], p.k)
        out.extend((int(q_ids[i]), int(v_ids[at[x]]), int(scores[x])) for x in best)

    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bound > 0, bound / (q_len * longest * slack), -1.0)  # least cosine; inf for empty lengths
        need = np.where(bound > 0, bound / (q_len * slack), -1.0)  # least length
    by_length = np.flatnonzero((local <= 1) & (local < p.steep))
    if len(by_length):
        ends = np.searchsorted(-v_len, -need[by_length], side="right")
        products = _products(q[by_length], v[:ends.max()])
        for i, end, row in zip(by_length.tolist(), ends.tolist(), products, strict=True):
            take(i, np.arange(end), row[:end])
    by_coordinate = np.flatnonzero((local <= 1) & (local >= p.steep))
    if len(by_coordinate):
        unit = v / v_len[:, None].clip(1e-300)
        for i in by_coordinate.tolist():
            u, t = q[i] / q_len[i], local[i]
            left = v_len >= need[i]
            for c in np.argsort(-np.abs(u), kind="stable")[:p.focus]:
                spread = math.sqrt(max(0.0, (1 - u[c] * u[c]) * (1 - t * t)))
                # the cosine is t at least, so it lies between t and 1 times the shared part
                low = u[c] * t - spread if u[c] > -t else -1.0
                high = u[c] * t + spread if u[c] < t else 1.0
                left &= (unit[:, c] >= low - 1e-9) & (unit[:, c] <= high + 1e-9)
            at = np.flatnonzero(left)
            take(i, at, _products(q[i:i + 1], v[at])[0] if len(at) else np.zeros(0, dtype=np.int64))
    return out


def _result(rows: list[tuple[int, int, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def _searcher(p: Params):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return _result([])
        bound = queries.column("bound").cast(pa.float64()).fill_null(-math.inf).to_numpy()
        return _result(search_block(queries.column("vec_id").to_numpy(), _matrix(queries, "v"), bound,
                                    vectors.column("vec_id").to_numpy(), _matrix(vectors, "v"), p))
    return run


def _apart(df: DataFrame) -> DataFrame:
    """Columns of their own, so that a frame can meet one it was made from."""
    return df.toDF(*df.columns)


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * component) of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return vectors.where(ok).select("vec_id", _floor("embedding", scale).alias("v")).distinct()


def _floor(column: str, scale: float) -> Column:
    def floor(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole
    return F.transform(column, floor)


def top_k(vectors: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best by inner product; ``vectors`` has ``vec_id`` and ``v``."""
    ship_package(vectors.sparkSession)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = saved(vectors.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"), is_query.alias("asks")))
    bucket = F.when(F.col("norm") > 0, F.floor(F.ln("norm") / -math.log(p.ratio))).otherwise(-1)
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    asked = rows.where("asks").groupBy("dim").agg(F.ceil(F.count("*") / p.queries).cast("int").alias("query_blocks"))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    query_rows = rows.where("asks").join(asked, "dim").withColumn("query_block", part("query_blocks"))
    blocks = rows.join(sizes, ["dim", "bucket"]).join(asked, "dim").withColumn("block", part("blocks"))

    # first bounds: queries against some of the longest vectors of their dimension, about `first` of each bucket it takes
    longer = Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    top = sizes.withColumn("longer", F.coalesce(F.sum("n").over(longer), F.lit(0))).where(F.col("longer") < p.first)
    top = top.select("dim", "bucket", F.ceil(F.col("n") / p.first).cast("int").alias("every"))
    first = rows.join(top, ["dim", "bucket"]).where(part("every") == 0)
    first = first.join(asked, "dim").select("dim", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"))
    asking = query_rows.select("dim", "query_block", "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    start = asking.groupBy("dim", "query_block").cogroup(_apart(first).groupBy("dim", "query_block")).applyInArrow(_searcher(p), RESULT)
    bounds = start.groupBy("query_id").agg(F.when(F.count("*") >= p.k, F.min("score")).cast("double").alias("bound"))

    # every block of queries meets every block of vectors of its dimension
    keys = ["dim", "query_block", "bucket", "block"]
    asking = query_rows.drop("bucket").join(bounds, F.col("vec_id") == F.col("query_id"), "left").join(sizes, "dim")
    asking = asking.select("dim", "query_block", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v", "bound")
    met = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "bucket", "block", "vec_id", "v")
    found = asking.groupBy(*keys).cogroup(_apart(met).groupBy(*keys)).applyInArrow(_searcher(p), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
