"""Line deduplication by pairwise alignment of overlapping documents.

1. Lines that occur in more than one document are found by hash. A run of such lines
   that follow each other is kept if it holds ``min_words`` words or more: no shorter
   run can hold a block that is deleted.
2. Earlier documents are proposed by block: of the kept lines, every
   shortest run of ``min_words`` words or more that begins or ends at a line proposes the
   first document that holds the whole run. Each line of a block that any earlier
   document shares is in such a run, so no block is missed however many documents hold
   its lines, and pairs grow with the lines.
3. Each pair is aligned by patience diff over its shared lines: lines that are unique
   in both anchor the longest increasing sequence (equal occurrences, where none is),
   blocks grow from the anchors over equal neighbours, and the gaps are aligned the same
   way. Blocks that this leaves, as they moved or repeat, are found by their minimal runs.
4. Blocks of ``min_words`` words or more are deleted from the later document.

"Later" is by document id, then by hash of the text. The first holder of a block is
never deleted from on its account.

Defined cases: null texts stay null, empty texts empty; null ids come first; rows that
agree in id and text count as one document and keep their rows; lines are whole lines,
without the white space around them; lines of white space alone take no part; lines that repeat
within one document only stay; texts are read whole; an empty table gives an empty
result; further columns pass through :func:`deduplicate`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codehealth.llm.common import saved, ship_package

@dataclass(frozen=True)
class Params:
    min_words: int = 25


def _anchors(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest sequence of pairs that increases in both places; ``pairs`` is sorted by the first."""
    tails: list[int] = []
    tail_at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before.append(tail_at[k - 1] if k else -1)
        tails[k:k + 1] = [b]
        tail_at[k:k + 1] = [i]
    out, i = [], tail_at[-1] if tail_at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _nth(x: list, start: int, end: int) -> dict:
    """Places of ``x`` from ``start`` to ``end`` by line and number of its occurrence there."""
    seen: Counter = Counter()
    out = {}
    for i in range(start, end):
        out[x[i], seen[x[i]]] = i
        seen[x[i]] += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment of two sequences: matching places, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal beginnings
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:  # and ends
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a[x] == 1}
        anchors = _anchors([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place])
        if not anchors:  # no line is unique in both: pair the k-th occurrences
            places = _nth(b, b0, b1)
            anchors = _anchors([(i, places[x]) for x, i in _nth(a, a0, a1).items() if x in places])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False) if p + 1 < q and r + 1 < s]
    return sorted(out)


def minimal_runs(at, words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the shortest runs with enough words that begin, or end, at a line."""
    at, n = np.asarray(at), len(at)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    starts = np.concatenate([np.arange(n), np.searchsorted(total, total[1:] - min_words, "right") - 1])
    ends = np.concatenate([np.searchsorted(total, total[:-1] + min_words) - 1, np.arange(n)])
    fits = (starts >= 0) & (ends < n)
    starts, ends = starts[fits], ends[fits]
    whole = at[ends] - at[starts] == ends - starts  # lines that follow each other
    return starts[whole], ends[whole]


def common_blocks(a: list, b: list, a_at: list[int], b_at: list[int], words: list[int], min_words: int) -> list[int]:
    """Places of ``b`` that are in blocks with enough words that ``a`` holds too.

    A block goes on as long as the aligned lines follow each other in both documents
    (``a_at`` and ``b_at``: their numbers there, lines without words left out). What one
    alignment leaves, blocks that moved or stand more often in one of the two, is looked
    up by the minimal runs of ``a``.
    """
    out, block = [], []
    for i, j in [*align(a, b), (-2, -2)]:
        if block and (i != block[-1][0] + 1 or j != block[-1][1] + 1 or a_at[i] != a_at[i - 1] + 1 or b_at[j] != b_at[j - 1] + 1):
            if sum(words[y] for _, y in block) >= min_words:
                out += [y for _, y in block]
            block = []
        block.append((i, j))
    cut, in_a = set(out), set(a)
    left = [(x, y) for x, y in zip(*map(np.ndarray.tolist, minimal_runs(b_at, words, min_words)), strict=True)
            if b[x] in in_a and b[y] in in_a and not cut.issuperset(range(x, y + 1))]
    if left:
        size = dict(zip(b, words, strict=True))  # a line that is not in b is in no common run
        runs = minimal_runs(a_at, [size.get(x, 0) for x in a], min_words)
        held = {tuple(a[x:y + 1]) for x, y in zip(*map(np.ndarray.tolist, runs), strict=True)}
        for x, y in left:
            if tuple(b[x:y + 1]) in held:
                cut.update(range(x, y + 1))
    return sorted(cut)


def _align_batches(min_words: int):
    def lists(batch: pa.RecordBatch, name: str):
        column = batch.column(name)
        flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        flat, first = flat.tolist(), offsets[0]
        return [flat[x - first:y - first] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [lists(batch, c) for c in ("a_key", "a_check", "a_at", "b_key", "b_check", "b_at", "b_words", "b_no")]
            cut = [[no[y] for y in common_blocks(list(zip(ak, ac, strict=True)), list(zip(bk, bc, strict=True)), aa, ba, bw, min_words)]
                   for ak, ac, aa, bk, bc, ba, bw, no in zip(*columns, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int32)
            values = pa.array([y for x in cut for y in x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc", "cut"])
    return run


def _identity(text: str = "text"):
    return F.struct("doc_id", F.xxhash64(text).alias("hash"))


def _run_batches(min_words: int):
    odd = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(odd), -1, 1 << 64))

    def powers(x: np.uint64, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places = [], []
            for i in range(batch.num_rows):
                key, check, at, words = (batch.column(c)[i].values.to_numpy() for c in ("key", "check", "at", "words"))
                n = len(at)
                starts, ends = minimal_runs(at, words, min_words)
                up, down = powers(odd, n), powers(back, n)
                both = []
                for x in (key, check):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.view(np.uint64) * up, dtype=np.uint64)])
                    both.append((sums[ends + 1] - sums[starts]) * down[starts])
                found = np.unique(np.stack(both, axis=1), axis=0)
                hashes.append(found)
                places += [i] * len(found)
            found = np.concatenate(hashes).view(np.int64) if hashes else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(places, pa.int64())), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc", "run", "run_check"])
    return run


def by_block(sequences: DataFrame, p: Params) -> DataFrame:
    """``doc`` and ``partner``: for each minimal run of a document the first document that holds it."""
    parts = sequences.select("doc", *[F.col(f"items.{c}").alias(c) for c in ("key", "check", "at", "words")])
    runs = parts.mapInArrow(_run_batches(p.min_words), "doc struct<doc_id: bigint, hash: bigint>, run bigint, run_check bigint")
    first = runs.groupBy("run", "run_check").agg(F.min("doc").alias("partner"), F.max("doc").alias("last")).where("partner < last").drop("last")
    return runs.join(first, ["run", "run_check"]).where("partner < doc").select("doc", "partner").distinct()


def removals(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc`` (id and text hash) and ``cut``, the ascending numbers (from 0) of the lines to delete."""
    ship_package(docs.sparkSession)
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))
    lines = docs.where("text is not null").select(_identity().alias("doc"), F.posexplode(F.filter(numbered, lambda x: x["line"] != "")).alias("at", "x"))
    lines = lines.select("doc", "at", "x.no", "x.line")
    lines = lines.select("doc", "at", "no", F.xxhash64("line").alias("key"), F.xxhash64(F.concat(F.lit("#"), "line")).alias("check"),
                         F.size(F.split("line", r"\s+")).alias("words")).distinct()  # rows that are one document
    lines = saved(lines)
    ends = lines.groupBy("key", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    holders = ends.where("first < last").select("key", "check")
    shared = lines.join(holders, ["key", "check"])
    by_place = Window.partitionBy("doc").orderBy("at")
    runs = shared.withColumn("run", F.col("at") - F.row_number().over(by_place))
    runs = runs.withColumn("held", F.sum("words").over(Window.partitionBy("doc", "run"))).where(F.col("held") >= p.min_words)
    item = F.struct("at", "no", "key", "check", "words")
    sequences = runs.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sequences = saved(sequences)
    partners = by_block(sequences, p)
    a = sequences.select(F.col("doc").alias("partner"), F.col("items.key").alias("a_key"), F.col("items.check").alias("a_check"), F.col("items.at").alias("a_at"))
    b = sequences.select("doc", F.col("items.key").alias("b_key"), F.col("items.check").alias("b_check"),
                         F.col("items.at").alias("b_at"), F.col("items.no").alias("b_no"), F.col("items.words").alias("b_words"))
    pairs = partners.join(a, "partner").join(b, "doc").drop("partner")
    cut = pairs.mapInArrow(_align_batches(p.min_words), "doc struct<doc_id: bigint, hash: bigint>, cut array<int>")
    return cut.select("doc", F.explode("cut").alias("line")).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("cut"))


def deduplicate(docs: DataFrame, p: Params = Params(), cut: str = "line_cut") -> DataFrame:
    """``docs`` with the lines removed from ``text``, and their numbers in a new column."""
    cuts = removals(docs, p).select(F.col("doc").alias("__cut_doc"), F.col("cut").alias(cut))
    rows = docs.withColumn("__doc", _identity())
    rows = rows.join(cuts, F.col("__doc") == F.col("__cut_doc"), "left").drop("__doc", "__cut_doc")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(cut, i))
    return rows.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
