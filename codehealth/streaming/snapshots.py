"""Incremental ingest of snapshot summaries with Structured Streaming.

New ``summary.json`` files landing in the history store are picked up by a
file-source stream; each micro-batch is reduced to per-snapshot status counts
and trend metrics and appended to partitioned tables through
``foreachBatch``. The stream's checkpoint (the caller passes a folder on the
shared file system) makes the ingest restartable and exactly-once per file.

:func:`delta_stream` follows each repository's trend while snapshots arrive in any order: a state
keyed by repository holds its trend rows, and every batch emits the deltas (W1) of the
snapshots that came and of those that now follow one of them. :func:`current_rows` reads what the
batches wrote, the latest row of each snapshot.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codehealth.functions import formatting as fmt
from codehealth.operators.history import METRIC_KINDS, TREND_KEYS
from codehealth.params import SNAPSHOT_VERSION
from codehealth.sources import store

SNAP = ["repo", "snapshot_id"]

# functions run on executors travel as a whole: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def summary_stream(spark: SparkSession, base: str) -> DataFrame:
    """Streaming DataFrame of valid summaries under ``base``."""
    raw = (spark.readStream.schema(store.SUMMARY).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad")
           .json(f"{base.rstrip('/')}/*/snapshots/*/summary.json"))
    keyed = raw.select(*store._keys(F.col("_metadata.file_path")), "*")
    return keyed.filter(F.col("_bad").isNull() & (F.col("version") == SNAPSHOT_VERSION)).drop("_bad")


def _write_batch(out_base: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        checks = store.checks_of(batch)
        status = checks.groupBy(*SNAP).agg(
            F.count_if(F.col("status") == "pass").alias("pass"),
            F.count_if(F.col("status") == "warn").alias("warn"),
            F.count_if(F.col("status") == "fail").alias("fail"),
            F.count_if(F.col("status") == "skip").alias("skip"))
        trend = store.trend_from_summaries(batch)
        rows = (batch.select(*SNAP, "timestamp").join(status, SNAP, "left").join(trend, SNAP, "left")
                .withColumn("epoch", F.lit(epoch_id)))
        _write_epoch(rows, f"{out_base.rstrip('/')}/snapshot_rows")
    return write


def _write_epoch(rows: DataFrame, path: str) -> None:
    # Re-running an epoch after a failure rewrites the same partitions.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def start_ingest(spark: SparkSession, base: str, out_base: str, checkpoint_location: str,
                 available_now: bool = True):
    """Start the ingest query; with ``available_now`` it processes what is
    there and stops (batch-style backfill), otherwise it keeps polling."""
    q = (summary_stream(spark, base).writeStream.foreachBatch(_write_batch(out_base))
         .option("checkpointLocation", checkpoint_location))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


# ---- W1 while snapshots arrive -------------------------------------------------------------
def _kind(key: str) -> str:
    return "double" if key == "duplication" else "bigint"


_ROW = ", ".join(["snapshot_id string", *[f"{k} {_kind(k)}" for k in TREND_KEYS]])
_OUT = f"repo string, {_ROW}, " + ", ".join(f"{k}_delta {_kind(k)}" for k in TREND_KEYS)
_STATE = "times array<bigint>, ids array<string>, " + ", ".join(f"{k} array<{_kind(k)}>" for k in TREND_KEYS)


def _value(key: str, value):
    """A number as the state holds it; whole ones come as text, since pandas has no whole numbers beside nulls."""
    if value is None or value != value:
        return None
    return float(value) if key == "duplication" else int(value)


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One repository's new rows: keep them in time order, emit each with the row before it, and the
    row after it anew. Rows are (time, id, metrics...); a snapshot that comes again replaces its row."""
    held = [list(r) for r in zip(*state.get, strict=True)] if state.exists else []
    at_id = {r[1]: r for r in held}
    fresh = set()
    for batch in batches:
        for r in batch[["time", "snapshot_id", *TREND_KEYS]].astype(object).itertuples(index=False, name=None):
            row = [_value("time", r[0]), r[1], *map(_value, TREND_KEYS, r[2:])]
            old = at_id.get(row[1])
            # within a batch and for one snapshot the greatest row stays, whatever order rows come in
            if old is not None and row[1] in fresh and _rank(old) >= _rank(row):
                continue
            at_id[row[1]] = row
            fresh.add(row[1])
    previous = {r[1]: held[i - 1][1] if i else None for i, r in enumerate(held)}
    rows = sorted(at_id.values(), key=_place)
    out = []
    for i, row in enumerate(rows):
        before = rows[i - 1] if i else None
        moved = row[1] in previous and previous[row[1]] != (before[1] if before else None)
        if moved or row[1] in fresh or (before and before[1] in fresh):
            delta = [None if before is None or a is None or b is None else a - b for a, b in
                     zip(row[2:], before[2:] if before else row[2:], strict=True)]
            out.append((key[0], *row[1:], *delta))
    state.update(tuple(list(c) for c in zip(*rows, strict=True)))
    frame = pd.DataFrame(out, columns=["repo", "snapshot_id", *TREND_KEYS, *[f"{k}_delta" for k in TREND_KEYS]])
    for k in TREND_KEYS:
        kind = "float64" if k == "duplication" else "Int64"
        frame[[k, f"{k}_delta"]] = frame[[k, f"{k}_delta"]].astype(kind)
    yield frame


def _place(row: list) -> tuple:
    return row[0] is not None, row[0] or 0, row[1]  # as the batch windows order: null times first


def _rank(row: list) -> list:
    return [(v is not None, v or 0) for v in (row[0], *row[2:])]


def delta_stream(rows: DataFrame) -> DataFrame:
    """W1 over a stream of trend rows (repo, snapshot_id, ts, the trend metrics), in update mode.

    A row may come late or again: the deltas of the snapshots that it changes are emitted
    anew, so the latest row of each snapshot equals ``history.metric_deltas`` over all that
    came. The state is one row of arrays a repository, eight values a snapshot. Rows without a
    snapshot id are left out; a null ``ts`` comes first; nulls of ``repo`` are one repository.
    """
    known = rows.filter(F.col("snapshot_id").isNotNull()).select(
        *SNAP, F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("time"),
        *[F.col(k).cast("double" if k == "duplication" else "string").alias(k) for k in TREND_KEYS])
    out = known.groupBy("repo").applyInPandasWithState(_follow, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("duplication_delta", fmt.round_half_away(F.col("duplication_delta"), 1))


def trend_rows(summaries: DataFrame) -> DataFrame:
    """Trend rows (A13 with its time) of summaries row by row, as :func:`delta_stream` takes them: the first
    metric of each kind, all kinds needed. Usable on a stream, as nothing is grouped."""
    def first(kind: str, field: str):
        return F.try_element_at(F.filter("checks", lambda c: c["metrics"]["kind"] == kind), F.lit(1))["metrics"][field]
    fields = {"lines": ("stats-overview", "totalLines"), "complexity": ("stats-overview", "totalComplexity"),
              "unused": ("unused", "totalIssues"), "duplication": ("duplicates", "duplicatedLinesPercent"), "cycles": ("cycles", "cycleCount")}
    kinds = F.transform("checks", lambda c: c["metrics"]["kind"])
    full = F.size(F.array_intersect(kinds, F.array(*[F.lit(k) for k in METRIC_KINDS]))) == len(METRIC_KINDS)
    return summaries.select(*SNAP, F.try_to_timestamp("timestamp").alias("ts"),
                            *[F.when(full, first(*fields[k])).alias(k) for k in TREND_KEYS])


def start_deltas(rows: DataFrame, out_base: str, checkpoint_location: str, available_now: bool = True):
    """Write :func:`delta_stream` of a streaming DataFrame to ``metric_deltas`` under ``out_base``, a
    partition for each batch; a batch that runs again replaces its partition."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        _write_epoch(batch.withColumn("epoch", F.lit(epoch_id)), f"{out_base.rstrip('/')}/metric_deltas")
    q = (delta_stream(rows).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint_location))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def current_rows(spark: SparkSession, out_base: str, table: str = "metric_deltas") -> DataFrame:
    """The latest row of each snapshot in a table that the batches wrote (later ones replace earlier ones)."""
    rows = spark.read.parquet(f"{out_base.rstrip('/')}/{table}")
    row = F.struct(*[c for c in rows.columns if c not in (*SNAP, "epoch")])
    return rows.groupBy(*SNAP).agg(F.max_by(row, "epoch").alias("row")).select(*SNAP, "row.*")
