"""Snapshot history: status counts, first-metric lookup, trend vectors,
deltas, ranges, positions and commit selection.

Per-check rows are reduced to one row per snapshot with ``groupBy`` (partial
aggregation, so a repository with a third of all checks is still cheap);
windows only run over the per-snapshot table, partitioned by repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codehealth.functions import formatting as fmt

SNAP = ["repo", "snapshot_id"]
METRIC_KINDS = ("stats-overview", "unused", "duplicates", "cycles")
TREND_KEYS = ("lines", "complexity", "unused", "duplication", "cycles")


def status_counts(checks: DataFrame) -> DataFrame:
    """A2 + P8: pass/warn/fail/skip counts and the failure gate per snapshot."""
    return checks.groupBy(*SNAP).agg(
        F.count_if(F.col("status") == "pass").alias("pass"),
        F.count_if(F.col("status") == "warn").alias("warn"),
        F.count_if(F.col("status") == "fail").alias("fail"),
        F.count_if(F.col("status") == "skip").alias("skip"),
        F.bool_or(F.col("status") == "fail").alias("failed"),
    )


def first_metrics(checks: DataFrame) -> DataFrame:
    """The first check (lowest check_idx) carrying each metric kind."""
    with_kind = checks.filter(F.col("kind").isNotNull())
    return with_kind.groupBy(*SNAP, "kind").agg(
        F.min("check_idx").alias("check_idx"),
        F.min_by("name", "check_idx").alias("name"),
        F.min_by("count_value", "check_idx").alias("count_value"),
        F.min_by("percent_value", "check_idx").alias("percent_value"),
    )


def trend_vector(first: DataFrame) -> DataFrame:
    """Lines, complexity, unused, duplication, cycles per snapshot.

    All five are NULL unless all four metric kinds are present.
    """
    def pick(kind, col):
        return F.max(F.when(F.col("kind") == kind, col))
    agg = first.groupBy(*SNAP).agg(
        pick("stats-overview", F.col("count_value")).alias("lines"),
        pick("stats-overview", F.floor(F.col("percent_value"))).alias("complexity"),
        pick("unused", F.col("count_value")).alias("unused"),
        pick("duplicates", F.col("percent_value")).alias("duplication"),
        pick("cycles", F.col("count_value")).alias("cycles"),
        F.count_distinct(F.when(F.col("kind").isin(*METRIC_KINDS), F.col("kind"))).alias("kinds"),
    )
    complete = F.col("kinds") == len(METRIC_KINDS)  # a run may carry further kinds
    return agg.select(*SNAP, *[F.when(complete, F.col(k)).alias(k) for k in TREND_KEYS])


def snapshots(checks: DataFrame) -> DataFrame:
    """Per-snapshot summary: timestamp, duration and status counts."""
    base = checks.groupBy(*SNAP).agg(F.min("ts").alias("ts"), F.sum("duration_ms").alias("duration_ms"))
    return base.join(status_counts(checks), on=SNAP)


def _order(desc: bool = False):
    if desc:
        return Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    return Window.partitionBy("repo").orderBy("ts", "snapshot_id")


def metric_deltas(trend: DataFrame, snaps: DataFrame) -> DataFrame:
    """Each trend metric minus the previous snapshot's (NULL on the first);
    duplication to one decimal, the others whole."""
    t = trend.join(snaps.select(*SNAP, "ts"), on=SNAP)
    w = _order()
    out = t
    for k in TREND_KEYS:
        d = F.col(k) - F.lag(k).over(w)
        out = out.withColumn(f"{k}_delta", fmt.round_half_away(d, 1) if k == "duplication" else d)
    return out.select(*SNAP, *TREND_KEYS, *[f"{k}_delta" for k in TREND_KEYS])


def trend_line(trend: DataFrame, snaps: DataFrame) -> DataFrame:
    """J2 + F9: 'Lines n (±d) · Complexity … · Unused … · Duplication x% (±y%) · Cycles …'
    against the previous snapshot; NULL when either side lacks a metric kind."""
    t = trend.join(snaps.select(*SNAP, "ts"), on=SNAP)
    w = _order()
    prev = {k: F.lag(k).over(w) for k in TREND_KEYS}
    t = t.select(*SNAP, *TREND_KEYS, *[prev[k].alias(f"prev_{k}") for k in TREND_KEYS])
    parts = [
        F.concat(F.lit("Lines "), fmt.format_number(F.col("lines")), F.lit(" ("),
                 fmt.format_delta(F.col("lines") - F.col("prev_lines")), F.lit(")")),
        F.concat(F.lit("Complexity "), fmt.format_number(F.col("complexity")), F.lit(" ("),
                 fmt.format_delta(F.col("complexity") - F.col("prev_complexity")), F.lit(")")),
        F.concat(F.lit("Unused "), fmt.format_number(F.col("unused")), F.lit(" ("),
                 fmt.format_delta(F.col("unused") - F.col("prev_unused")), F.lit(")")),
        F.concat(F.lit("Duplication "), fmt.format_percent(F.col("duplication")), F.lit(" ("),
                 fmt.format_percent_delta(F.col("duplication") - F.col("prev_duplication")), F.lit(")")),
        F.concat(F.lit("Cycles "), fmt.format_number(F.col("cycles")), F.lit(" ("),
                 fmt.format_delta(F.col("cycles") - F.col("prev_cycles")), F.lit(")")),
    ]
    complete = F.lit(True)
    for k in TREND_KEYS:
        complete = complete & F.col(k).isNotNull() & F.col(f"prev_{k}").isNotNull()
    return t.select(*SNAP, F.when(complete, F.concat_ws(fmt.TREND_SEPARATOR, *parts)).alias("trend_line"))


def snapshot_range(snaps: DataFrame) -> DataFrame:
    """First and last snapshot timestamp per repository."""
    return snaps.groupBy("repo").agg(fmt.iso_timestamp(F.min("ts")).alias("start"),
                                     fmt.iso_timestamp(F.max("ts")).alias("end"))


def positions(snaps: DataFrame) -> DataFrame:
    """Position (oldest first), total, previous and next snapshot ids."""
    w = _order()
    wall = Window.partitionBy("repo")
    return snaps.select(*SNAP,
                        F.row_number().over(w).cast("bigint").alias("position"),
                        F.count(F.lit(1)).over(wall).alias("total"),
                        F.lag("snapshot_id").over(w).alias("previous_id"),
                        F.lead("snapshot_id").over(w).alias("next_id"))


def last_n(snaps: DataFrame, choices=(10, 25)) -> DataFrame:
    """Membership of each snapshot in the last-N ranges, and whether the
    range control for N is shown (more than N snapshots exist)."""
    wdesc = _order(desc=True)
    wall = Window.partitionBy("repo")
    out = snaps.select(*SNAP, F.row_number().over(wdesc).alias("age"),
                       F.count(F.lit(1)).over(wall).alias("total"))
    cols = [*SNAP]
    for n in choices:
        cols += [(F.col("age") <= n).alias(f"in_last_{n}"), (F.col("total") > n).alias(f"show_last_{n}")]
    return out.select(*cols)


def history_listing(snaps: DataFrame, trend: DataFrame) -> DataFrame:
    """T10 + F5/F6/F7/F11: newest-first listing with display columns."""
    t = snaps.join(trend, on=SNAP, how="left")
    w = _order(desc=True)
    return t.select(
        *SNAP,
        F.row_number().over(w).cast("bigint").alias("position"),
        fmt.iso_timestamp(F.col("ts")).alias("timestamp"),
        fmt.human_date(F.col("ts")).alias("label"),
        fmt.status_summary(F.col("pass"), F.col("warn"), F.col("fail"), F.col("skip")).alias("status"),
        fmt.format_duration(F.col("duration_ms")).alias("duration"),
        fmt.format_number(F.col("lines")).alias("lines"),
        fmt.format_number(F.col("complexity")).alias("complexity"),
        fmt.format_number(F.col("unused")).alias("unused"),
        fmt.format_percent(F.col("duplication")).alias("duplication"),
        fmt.format_number(F.col("cycles")).alias("cycles"),
    )


def derive_status(checks: DataFrame) -> DataFrame:
    """A check that was skipped or failed stays so; otherwise the status comes
    from its metrics, and without metrics from the wording of its own output. A
    check is told by its ``kind`` or, without one, its ``name``; the words of one
    check mean nothing in the output of another. With an ``exit_code`` column, a
    code other than 0 makes a cycle check without metrics a warning and a line-count check a
    failure; other checks end with such codes when they only found something."""
    count = F.col("count_value")
    check = F.coalesce(F.col("kind"), F.col("name"))
    own_words = (F.when(check == "unused", F.lit("Unused|unused|Unlisted"))
                 .when(check == "duplicates", F.lit(r"Clone found|Found \d+ clones"))
                 .when(check == "cycles", F.lit("error no-circular")))
    from_metrics = (F.when(F.col("kind").isin("unused", "duplicates", "cycles") & count.isNotNull(),
                           F.when(count > 0, F.lit("warn")).otherwise(F.lit("pass"))))
    text = F.coalesce(F.col("output"), F.lit(""))
    ended_badly = (F.coalesce(F.col("exit_code") != 0, F.lit(False)) if "exit_code" in checks.columns
                   else F.lit(False))
    from_text = F.when(F.regexp_like(text, own_words) | (ended_badly & (check == "cycles")),
                       F.lit("warn")).otherwise(F.lit("pass"))
    status = (F.when(F.col("status").isin("skip", "fail"), F.col("status"))
              .when(ended_badly & check.startswith("stats"), F.lit("fail"))
              .otherwise(F.coalesce(from_metrics, from_text)))
    return checks.select(*SNAP, "check_idx", "name", status.alias("derived_status"))


def every_nth_commits(commits: DataFrame, count: int, every: int) -> DataFrame:
    """Per repository, commits at first-parent distance every, 2*every, …,
    count*every from HEAD (HEAD itself is index 0), oldest first.

    Repositories whose history is not longer than count*every get no rows
    (the reference raises for them); :func:`short_histories` names them. Only the newest count*every + 1 commits
    of each repository are needed; ``row_number() <= k`` is planned as a
    partial WindowGroupLimit, so a repository with a huge history ships at
    most k rows per map task.
    """
    if not (isinstance(count, int) and isinstance(every, int)) or count < 1 or every < 1:
        raise ValueError("count and every must be positive integers")
    need = count * every + 1
    w = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("sha"))
    head = commits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= need)
    avail = head.withColumn("available", F.count(F.lit(1)).over(Window.partitionBy("repo")))
    idx = F.col("rn") - 1
    sel = avail.filter((F.col("available") >= need) & (idx > 0) & (idx % every == 0))
    return sel.select("repo", "sha", "short_sha", idx.cast("bigint").alias("idx"),
                      (F.lit(count + 1) - idx / every).cast("bigint").alias("order"))


def short_histories(commits: DataFrame, count: int, every: int) -> DataFrame:
    """The repositories that :func:`every_nth_commits` passes over, with the number of commits
    they have and need."""
    return (commits.groupBy("repo").agg(F.count(F.lit(1)).alias("available"))
            .withColumn("needed", F.lit(count * every + 1).cast("bigint")).filter("available < needed"))


def previous_snapshot(runs: DataFrame, snaps: DataFrame) -> DataFrame:
    """J2 for incoming runs: the newest stored snapshot strictly before each
    run (``runs(repo, run_id, ts)``, ``snaps(repo, snapshot_id, ts)``).

    An as-of lookup without pairing runs with snapshots: both are unioned,
    ordered by time within the repository (a run sorts before a snapshot with
    the same time, so only strictly older snapshots qualify), and the last
    snapshot id seen so far is carried forward with ``last(ignorenulls)``.
    """
    r = runs.select("repo", "ts", F.col("run_id"), F.lit(None).cast("string").alias("snapshot_id"),
                    F.lit(0).alias("order"))
    s = snaps.select("repo", "ts", F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"),
                     F.col("snapshot_id"), F.lit(1).alias("order"))
    w = (Window.partitionBy("repo").orderBy("ts", "order", "snapshot_id")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = r.unionByName(s).withColumn("previous_id", F.last("snapshot_id", ignorenulls=True).over(w))
    return both.filter(F.col("order") == 0).select("repo", "run_id", "ts", "previous_id")
