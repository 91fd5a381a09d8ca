"""Churn: how often files change, and where change meets size.

``commits(repo, sha, ts, subject)`` and ``touches(sha, file, lines)``; all results
are per repository. Line items of one commit and file are reduced to one row before
anything is counted, so no distinct aggregate expands the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codehealth.params import CHURN_DAYS


def _recent(commits: DataFrame, days: int) -> DataFrame:
    anchor = commits.groupBy("repo").agg(F.max("ts").alias("anchor"))
    return (commits.join(anchor, "repo")
            .filter(F.col("ts") >= F.col("anchor") - F.expr(f"INTERVAL {int(days)} DAYS"))
            .drop("anchor"))


def _file_commits(touches: DataFrame) -> DataFrame:
    return touches.groupBy("sha", "file").agg(F.sum("lines").alias("lines"))


def churn(commits: DataFrame, touches: DataFrame, days: int = CHURN_DAYS,
          subject_regex: str | None = "^fix") -> DataFrame:
    """C17: per repository and file, distinct commits touching it in the last
    ``days`` days before the repository's newest commit, those whose subject
    matches ``subject_regex``, and the lines they touched."""
    fix = F.col("subject").rlike(subject_regex) if subject_regex else F.lit(False)
    recent = _recent(commits.select("repo", "sha", "ts", "subject"), days).select("repo", "sha", fix.alias("fix"))
    return _file_commits(touches).join(recent, "sha").groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if("fix").alias("fix_commits"),
        F.sum("lines").alias("lines_touched"))


def monthly_churn(commits: DataFrame, touches: DataFrame) -> DataFrame:
    """C17 series: distinct commits per repository, file and month."""
    c = commits.select("repo", "sha", F.date_format("ts", "yyyy-MM").alias("month"))
    return (_file_commits(touches).join(c, "sha").groupBy("repo", "file", "month")
            .agg(F.count(F.lit(1)).alias("commits")))


def churn_hotspots(churned: DataFrame, sizes: DataFrame, limit: int = 20) -> DataFrame:
    """score = commits x size, quadrant by comparison with the repository's
    averages (compared exactly in integers: x * n >= sum), top ``limit`` of each
    repository by score. ``sizes``: (repo, path, size)."""
    j = churned.join(sizes.select("repo", F.col("path").alias("file"), "size"), ["repo", "file"])
    totals = j.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum("commits").alias("sum_commits"),
                                   F.sum("size").alias("sum_size"))
    t = j.join(totals, "repo")
    high_churn = F.col("commits") * F.col("n") >= F.col("sum_commits")
    high_size = F.col("size") * F.col("n") >= F.col("sum_size")
    quadrant = (F.when(high_churn & high_size, F.lit("hotspot"))
                .when(high_churn, F.lit("churning"))
                .when(high_size, F.lit("large"))
                .otherwise(F.lit("calm")))
    scored = t.select("repo", "file", "commits", F.col("size").cast("bigint").alias("size"),
                      (F.col("commits") * F.col("size")).cast("bigint").alias("score"), quadrant.alias("quadrant"))
    w = Window.partitionBy("repo").orderBy(F.desc("score"), F.asc("file"))
    return (scored.withColumn("position", F.row_number().over(w).cast("bigint"))
            .filter(F.col("position") <= limit))


def recurring_hotspots(monthly: DataFrame, top: int = 20) -> DataFrame:
    """Files in a repository's monthly top ``top`` (commits desc, file asc) in two
    consecutive months. The per-month cut is a partial WindowGroupLimit."""
    w = Window.partitionBy("repo", "month").orderBy(F.desc("commits"), F.asc("file"))
    ranked = monthly.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    nxt = ranked.select("repo", "file", F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1),
                                                      "yyyy-MM").alias("month"),
                        F.col("month").alias("next_month"))
    return ranked.join(nxt, ["repo", "file", "month"]).select("repo", "file", "month", "next_month")
