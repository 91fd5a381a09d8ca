"""Repair of conversations whose turns break the pattern user, assistant, user, assistant ...

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Its turns are aligned
with every feasible length of that string at the least cost (Wagner-Fischer): keep 0, rerole
3, delete 4 (blank and repeated turns must go), insert an empty turn 3; a truncated turn that
is not deleted adds 3. Of the cheapest alignments the one whose audit, the initials
of its edits in order, is least in ASCII order is taken.

The target strings of all lengths end alike, so one table of costs-to-go, rows left by roles
left, serves all of them: a length is read off where it begins. Ukkonen's band holds it
to the cells that the cost of a plain repair, the incumbent, can still reach. Audits are
traced back from every length of least cost and compared.

1. Features of the turns (no texts) are pre-aggregated; a turn is a duplicate unless it is the
   first, by turn, of its role and text (partial minimum, joined back).
2. Turns are dealt out by ranges of (conversation, turn) and cut into pieces of at most
   ``PIECE`` turns, so a very long conversation is many pieces in several tasks. A piece is aligned once
   for each state that the pattern can be in before and after it.
3. One pass over the texts, sorted by conversation, streams: the pieces' tables come first and
   are chained by least cost, then each turn is edited and hashed as it passes. No
   conversation is held in memory: of each the task keeps the pieces' tables, at most 16 letters a turn.
   A hash of a whole text is sequential, so that pass takes a conversation in one task.

Defined cases: null roles and texts are one blank; turns are ordered with nulls first, then by
role, the text's first 16 characters and its digest; repeated rows are duplicates of the first; roles are
compared by their first character, an empty role fits nothing; null ids form one
conversation; empty tables give no rows; further columns do not matter; a conversation that is named in ``every`` but has no turns has zeros and an
empty audit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
PIECE = 128
BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
ROLES = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}
LEGAL = {"su", "ua", "au"}
INF = 1 << 60
#: what a conversation still needs when its last turn leaves the pattern in a state: nothing yet, after s, after an a, after a u
ENDINGS = {"^": (0, ""), "s": (2 * INSERT, "II"), "u": (0, ""), "a": (INSERT, "I")}


def damage(rows: DataFrame) -> DataFrame:
    """The turns after a made-up, repeatable damage of one in four of them."""
    spot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spot("conv_id"), F.lit(":"), spot("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(spot("text"), "[.!?]", "")).otherwise(spot("text"))
    hurt = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(spot("role")).alias("role"), text.alias("text"), k.alias("k"))
    return hurt.where("k != 0").withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "copy")


# ---- one piece ------------------------------------------------------------------------
# A turn is one letter: s, u, a or x by its role's initial, in upper case if truncated, or d if it must go.


def _fit(turn: str, role: str) -> int:
    """Cost of a turn as ``role``; its letter in the audit is K if the role is its own, else R."""
    if turn == "d":
        return INF
    return (KEEP if turn.lower() == role else REROLE) + (TRUNCATED if turn.isupper() else 0)


def _incumbent(turns: str, start: str, end: str) -> int:
    """The cost of one plain repair: living turns take the next role each, the last one goes if the end is then wrong."""
    living = [t for t in turns if t != "d"]
    cost, expects = 0, start
    if (len(living) % 2 == 0) != (start == end):
        if not living:
            return INSERT + DELETE * len(turns)
        living.pop()
    for t in living:
        cost += _fit(t, expects)
        expects = OTHER[expects]
    return cost + DELETE * (len(turns) - len(living))


class _Table:
    """Costs-to-go of all targets that leave the pattern expecting ``end``: rows left by roles left, in a band."""

    def __init__(self, turns: str, end: str):
        self.turns, n = turns, len(turns)
        self.odd = OTHER[end]  # the last role, and every second one before it
        bound = max(_incumbent(turns, s, end) for s in "ua") + 2 * INSERT
        self.less, more = bound // DELETE, bound // INSERT
        after = {0: 0}
        self.rows = [after]
        for left in range(1, n + 1):
            turn, row = turns[n - left], {}
            for r in range(max(0, left - self.less), left + more + 1):
                cost = DELETE + after.get(r, INF)
                if r:
                    cost = min(cost, _fit(turn, self.role(r)) + after.get(r - 1, INF), INSERT + row.get(r - 1, INF))
                if cost <= bound:
                    row[r] = cost
            self.rows.append(row)
            after = row
        self.rows.reverse()  # rows[i]: turns i and later

    def role(self, r: int) -> str:
        return self.odd if r % 2 else OTHER[self.odd]

    def lengths(self, i: int, first: str) -> list[tuple[int, int]]:
        """(cost, length) of every target that begins with the role ``first``, for the turns from ``i``."""
        return [(cost, r) for r, cost in self.rows[i].items() if r and self.role(r) == first]

    def trace(self, i: int, r: int) -> str:
        """The least audit among the cheapest alignments of the turns from ``i`` with the last ``r`` roles."""
        out, n = [], len(self.turns)
        while i < n or r:
            now = self.rows[i][r]
            if i < n and DELETE + self.rows[i + 1].get(r, INF) == now:
                out.append("D")
                i += 1
            elif r and INSERT + self.rows[i].get(r - 1, INF) == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[i].lower() == self.role(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(turns: str, starts: str) -> dict[str, dict[str, tuple[int, str]]]:
    """For each state in ``starts`` the cheapest (cost, audit) that leads to each state after the piece.

    No insert comes after the last turn: the next piece, or ``ENDINGS``, has it.
    """
    n = len(turns)
    gone = (DELETE * n, "D" * n)
    out = {s: {s: gone} for s in starts}
    tables = {end: _Table(turns, end) for end in "ua"}
    for end, table in tables.items():
        for start in starts:
            found = [(cost, 0, r) for cost, r in table.lengths(0, "a" if start == "a" else "u")]
            if start == "^":  # a kept s, with all before it deleted
                for p, turn in enumerate(turns):
                    if turn in "sS":
                        kept = DELETE * p + _fit(turn, "s")
                        found += [(kept + cost, p + 1, r) for cost, r in table.lengths(p + 1, "u")] if p + 1 < n else []
            if not found:
                continue
            least = min(found)[0]
            audits = [("D" * (i - 1) + "K" if i else "") + table.trace(i, r) for cost, i, r in found if cost == least]
            out[start][end] = min(out[start].get(end, (INF, "")), (least, min(audits)))
    if "^" in starts:
        ends = [(DELETE * (n - 1) + _fit(t, "s"), "D" * p + "K" + "D" * (n - p - 1)) for p, t in enumerate(turns) if t in "sS"]
        if ends:
            out["^"]["s"] = min(ends)
    return out


@lru_cache(maxsize=20_000)
def _aligned(turns: str, starts: str) -> str:
    return json.dumps(align(turns, starts))


def chain(pieces: list[str]) -> tuple[int, str]:
    """Cost and audit of a conversation from its pieces' tables in order.

    Costs-to-go come backwards; then the least audit that keeps them is taken piece by piece.
    A piece's audits hold the same number of turns and end with one, so none begins another.
    """
    tables = [json.loads(p) for p in pieces]
    todo = {s: cost for s, (cost, _) in ENDINGS.items()}
    later = [todo]
    for table in reversed(tables):
        todo = {s: min((cost + todo[e] for e, (cost, _) in ends.items()), default=INF) for s, ends in table.items()}
        later.append(todo)
    later.reverse()
    state, out = "^", []
    for table, now, after in zip(tables, later, later[1:], strict=False):
        audit, state = min((audit, e) for e, (cost, audit) in table[state].items() if cost + after[e] == now[state])
        out.append(audit)
    return later[0]["^"], "".join(out) + ENDINGS[state][1]


@lru_cache(maxsize=20_000)
def _chained(piece: str) -> tuple[int, str]:
    return chain([piece])


# ---- tables ---------------------------------------------------------------------------


def _order(role: Column, text: Column) -> list[Column]:
    return [role, F.substring(text, 1, 16), F.unhex(F.md5(text.cast("binary")))]


def features(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, head, digest, blank, truncated, n, lead``: equal turns once, ``lead`` if the first of them is no duplicate."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    role, head, digest = _order(F.col("role"), F.col("text"))
    blank = shown == ""
    cut = ~blank & ~F.substring(shown, -1, 1).isin(".", "!", "?")
    same = rows.select("conv_id", "turn", "role", head.alias("head"), digest.alias("digest"), blank.alias("blank"), cut.alias("truncated"))
    same = same.groupBy(*same.columns).agg(F.count("*").alias("n"))
    first = same.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("t"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return same.join(first, on).withColumn("lead", F.col("turn").eqNullSafe(F.col("t"))).drop("c", "r", "d", "t")


def pieces(turns: DataFrame) -> DataFrame:
    """``conv_id, part, piece, blank, duplicate, truncated, aligned`` of the turns of ``features``."""
    order = ["conv_id", "turn", "role", "head", "digest"]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "lead", "n")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, none = TaskContext.get().partitionId(), object()
        now, letters, counts, piece, out, starts = none, [], [0, 0, 0], 0, [], "^sua"

        def flush(begun: str) -> None:
            nonlocal letters, counts, piece
            if letters:
                out.append((now, part, piece, *counts, _aligned("".join(letters), begun)))
                letters, counts, piece = [], [0, 0, 0], piece + 1

        for batch in batches:
            types[0] = batch.column(0).type
            for conv, initial, blank, truncated, lead, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is none or conv != now:
                    flush(starts)
                    # what came before a part's first conversation may lie in the part before
                    starts, now = "^sua" if now is none else "^", conv
                for copy in range(n):
                    duplicate = not blank and (copy > 0 or not lead)
                    letter = initial if initial in ("s", "u", "a") else "x"
                    letters.append("d" if blank or duplicate else letter.upper() if truncated else letter)
                    counts = [counts[0] + blank, counts[1] + duplicate, counts[2] + (truncated and not duplicate)]
                    if len(letters) == PIECE:
                        flush(starts)
                        starts = "^sua"
            if out:
                yield made(out)
                out = []
        flush(starts)
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)

    names = ["conv_id", "part", "piece", "blank", "duplicate", "truncated", "aligned"]
    types = [None, *[pa.int64()] * 5, pa.string()]
    return rows.mapInArrow(cut, f"conv_id {kind}, part bigint, piece bigint, blank bigint, duplicate bigint, truncated bigint, aligned string")


def repair(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``rows`` has ``conv_id, turn, role, text``; ``every`` names conversations (``conv_id``) that may have no rows.
    """
    ship_package(rows.sparkSession)
    one_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), one_blank("role"), one_blank("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    first = pieces(features(rows)).withColumn("kind", F.lit(0))
    parts = first.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    if every is not None:
        parts = parts.unionByName(every.select("conv_id").distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = _order(F.col("role"), F.col("text"))
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("part").asc_nulls_last(), "piece", "turn", *order)
    parts = parts.select("conv_id", "kind", "blank", "duplicate", "truncated", "aligned", "turn", "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, it = none, None
        out = []
        for batch in batches:
            types[0] = batch.column(0).type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is none or conv != now:
                    if it:
                        out.append((now, *it.end()))
                    now, it = conv, _Repair()
                it.add(*row)
            if out:
                yield made(out)
                out = []
        if it:
            yield made([*out, (now, *it.end())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
    return parts.mapInArrow(stream, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                                    "cost bigint, audit string, repaired_sha256 string")


class _Repair:
    """One conversation as it passes: pieces first, then turns in order."""

    def __init__(self):
        self.pieces, self.counts, self.audit = [], [0, 0, 0], None
        self.cost = self.at = self.illegal = self.turns = 0
        self.low = self.high = self.initial = self.last = None
        self.hash, self.lines, self.expects = hashlib.sha256(), 0, "u"

    def add(self, kind, blank, duplicate, truncated, aligned, turn, role, text) -> None:
        if kind == 0:
            if aligned is not None:
                self.pieces.append(aligned)
                self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated), strict=True)]
            return
        self._settle()
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        while self.audit[self.at] == "I":
            self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._line(role, text)
            self.expects = "a" if role[0] == "u" else "u"
        elif edit == "R":
            self._line(ROLES[self.expects], text)
            self.expects = OTHER[self.expects]

    def _settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = _chained(self.pieces[0]) if len(self.pieces) == 1 else chain(self.pieces)
            self.pieces = []

    def _insert(self) -> None:
        self._line(ROLES[self.expects], "")
        self.expects, self.at = OTHER[self.expects], self.at + 1

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def end(self) -> tuple:
        self._settle()
        while self.at < len(self.audit):
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts, self.illegal, self.cost, self.audit, self.hash.hexdigest())
