"""Health score per snapshot (0-100) with its trend.

One row per snapshot: five rounded sub-scores, their mean (weights 0.2) and
the change against the previous snapshot of the same repository. Inputs are
per-snapshot metric values and per-snapshot file-node counts of the tree,
both aggregated with ``groupBy``; the trend is a ``lag`` over the (small)
per-snapshot table, partitioned by repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codehealth.params import OVERLY_COMPLEX, OVERSIZED_CODE_LINES
from codehealth.operators.rankings import js_round

SNAP = ["repo", "snapshot_id"]
# ---- fixed values: sub-score weights and penalties --------------------------
WEIGHT = 0.2
MISSING_SCORE = 50.0
DUPLICATION_PENALTY = 5.0
UNUSED_PENALTY = 50.0
COMPLEXITY_PENALTY = 2.5
# -----------------------------------------------------------------------------


def tree_file_counts(tree: DataFrame) -> DataFrame:
    """File counts of every snapshot that has a tree, be it one without files."""
    is_file = F.col("kind") == "file"
    return tree.groupBy(*SNAP).agg(
        F.count_if(is_file).alias("file_nodes"),
        F.count_if(is_file & (F.col("code") > OVERSIZED_CODE_LINES)).alias("oversized_files"),
        F.count_if(is_file & (F.col("complexity") > OVERLY_COMPLEX)).alias("overly_complex_files"))


def health_scores(metrics: DataFrame, tree_counts: DataFrame | None) -> DataFrame:
    """A14 + W2.

    ``metrics``: (repo, snapshot_id, ts, total_files, total_code,
    total_complexity, total_issues, duplicated_lines_percent); a NULL metric
    means that check is missing (its sub-score is 50).
    ``tree_counts``: output of ``tree_file_counts`` (NULL tree -> 50 for the
    two file-based sub-scores).
    """
    m = metrics
    if tree_counts is not None:
        m = m.join(tree_counts.withColumn("has_tree", F.lit(True)), on=SNAP, how="left")
    else:
        m = (m.withColumn("has_tree", F.lit(None).cast("boolean"))
             .withColumn("file_nodes", F.lit(None).cast("bigint"))
             .withColumn("oversized_files", F.lit(None).cast("bigint"))
             .withColumn("overly_complex_files", F.lit(None).cast("bigint")))
    has_tree = F.coalesce(F.col("has_tree"), F.lit(False))
    denom = F.greatest(F.coalesce(F.when(F.col("file_nodes") > 0, F.col("file_nodes")),
                                  F.when(F.col("total_files") > 0, F.col("total_files")),
                                  F.lit(0)), F.lit(1))
    oversized_pct = F.coalesce(F.col("oversized_files"), F.lit(0)) / denom * 100
    overly_pct = F.coalesce(F.col("overly_complex_files"), F.lit(0)) / denom * 100
    stats_present = F.col("total_code").isNotNull()
    zero = F.lit(0.0)
    dup = F.when(F.col("duplicated_lines_percent").isNull(), F.lit(MISSING_SCORE)).otherwise(
        F.greatest(zero, 100 - F.col("duplicated_lines_percent") * DUPLICATION_PENALTY))
    unused = F.when(F.col("total_issues").isNull() | ~stats_present, F.lit(MISSING_SCORE)).otherwise(
        F.greatest(zero, 100 - (F.col("total_issues") / F.greatest(F.col("total_files"), F.lit(1)))
                   * UNUSED_PENALTY))
    cx = F.when(~stats_present, F.lit(MISSING_SCORE)).otherwise(
        F.greatest(zero, 100 - (F.col("total_complexity") / F.greatest(F.col("total_code"), F.lit(1)) * 100)
                   * COMPLEXITY_PENALTY))
    oversized = F.when(has_tree, F.greatest(zero, 100 - oversized_pct)).otherwise(F.lit(MISSING_SCORE))
    overly = F.when(has_tree, F.greatest(zero, 100 - overly_pct)).otherwise(F.lit(MISSING_SCORE))
    scored = m.select(
        *SNAP, "ts",
        js_round(dup).cast("bigint").alias("duplication_score"),
        js_round(unused).cast("bigint").alias("unused_score"),
        js_round(cx).cast("bigint").alias("complexity_score"),
        js_round(oversized).cast("bigint").alias("oversized_files_score"),
        js_round(overly).cast("bigint").alias("overly_complex_files_score"),
        F.coalesce(F.col("duplicated_lines_percent"), zero).alias("duplication_display"),
        oversized_pct.alias("oversized_files_percent"),
        overly_pct.alias("overly_complex_files_percent"),
    )
    overall = js_round(((((F.col("duplication_score") * WEIGHT + F.col("unused_score") * WEIGHT)
                         + F.col("complexity_score") * WEIGHT) + F.col("oversized_files_score") * WEIGHT)
                        + F.col("overly_complex_files_score") * WEIGHT)).cast("bigint")
    w = Window.partitionBy("repo").orderBy("ts", "snapshot_id")
    return (scored.withColumn("overall", overall)
            .withColumn("trend", F.coalesce(F.col("overall") - F.lag("overall").over(w), F.lit(0)).cast("bigint")))


def score_tier(score_col, inverted: bool = False):
    """>= 80 low, >= 50 medium, else high; hotspots use 100 - score."""
    s = (F.lit(100) - score_col) if inverted else score_col
    return F.when(s >= 80, F.lit("low")).when(s >= 50, F.lit("medium")).otherwise(F.lit("high"))
