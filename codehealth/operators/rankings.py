"""Per-snapshot rankings over tree nodes: hotspots and top files.

Normalising maxima are computed with a ``groupBy`` (partial aggregation) and
joined back on the snapshot key; the per-snapshot table is tiny, and AQE
turns the join into a broadcast after checking its materialised size. Top-k
filters use ``row_number() <= k``, which Spark plans as a partial
WindowGroupLimit ahead of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SNAP = ["repo", "snapshot_id"]

# ---- fixed values: hotspot weights and signal thresholds --------------------
FILE_WEIGHTS = {"complexity": 0.35, "size": 0.25, "issues": 0.40}
DIR_WEIGHTS = {"issues": 0.45, "complexity": 0.35, "size": 0.20}
SIGNAL_ACTIVE = {"complexity": 0.3, "size": 0.3, "issues": 0.1}
# -----------------------------------------------------------------------------


def js_round(x):
    """Math.round for non-negative values: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def round2(x):
    return js_round(x * 100) / 100


def _signals(nodes: DataFrame) -> DataFrame:
    maxima = nodes.groupBy(*SNAP).agg(
        F.greatest(F.max("complexity"), F.lit(1)).alias("max_complexity"),
        F.greatest(F.max("lines"), F.lit(1)).alias("max_lines"),
        F.greatest(F.max("total"), F.lit(1)).alias("max_issues"))
    return (nodes.join(maxima, on=SNAP)
            .withColumn("complexity_signal", F.col("complexity") / F.col("max_complexity"))
            .withColumn("size_signal", F.col("lines") / F.col("max_lines"))
            .withColumn("issues_signal", F.col("total") / F.col("max_issues")))


def _top(df: DataFrame, score, limit: int) -> DataFrame:
    scored = df.withColumn("score", js_round(score * 100).cast("bigint")).filter(F.col("score") > 0)
    w = Window.partitionBy(*SNAP).orderBy(F.desc("score"), F.asc("path"))
    ranked = scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
    # a tree with dependency information shows the instability of its files; it has no weight in the score
    instability = F.when(F.col("kind") == "file", F.coalesce("instability", F.lit(0.0))).otherwise(F.lit(0.0)) \
        if "instability" in df.columns else None
    return ranked.select(
        *SNAP, F.col("position").cast("bigint").alias("position"), "path", "name", "kind", "score",
        round2(F.col("complexity_signal")).alias("complexity_signal"),
        round2(F.col("size_signal")).alias("size_signal"),
        round2(F.col("issues_signal")).alias("issues_signal"),
        *([] if instability is None else [round2(instability).alias("instability_signal")]),
        "lines", "code", "complexity", "total")


def file_hotspots(tree: DataFrame, limit: int = 10) -> DataFrame:
    """W3 + T5: score = round((.35 cx + .25 size + .40 issues) * 100), score > 0, top k.

    Ties on score are broken by path (the reference keeps insertion order).
    """
    s = _signals(tree.filter(F.col("kind") == "file"))
    score = (F.col("complexity_signal") * FILE_WEIGHTS["complexity"]
             + F.col("size_signal") * FILE_WEIGHTS["size"]
             + F.col("issues_signal") * FILE_WEIGHTS["issues"])
    return _top(s, score, limit)


def dir_hotspots(tree: DataFrame, root: str = "src", limit: int = 5) -> DataFrame:
    """W4 + T6: directories except the root, .45 issues + .35 cx + .20 size."""
    s = _signals(tree.filter((F.col("kind") == "dir") & (F.col("path") != root)))
    score = (F.col("issues_signal") * DIR_WEIGHTS["issues"]
             + F.col("complexity_signal") * DIR_WEIGHTS["complexity"]
             + F.col("size_signal") * DIR_WEIGHTS["size"])
    return _top(s, score, limit)


def top_files_by(tree: DataFrame, metric: str, limit: int = 10) -> DataFrame:
    """T7 (code) / T8 (complexity): largest and most complex file nodes."""
    if metric == "code":
        order = [F.desc("code"), F.desc("lines"), F.desc("complexity")]
    elif metric == "complexity":
        order = [F.desc("complexity"), F.desc("code"), F.desc("lines")]
    else:
        raise ValueError(metric)
    w = Window.partitionBy(*SNAP).orderBy(*order, F.asc("path"))
    ranked = (tree.filter(F.col("kind") == "file")
              .withColumn("position", F.row_number().over(w))
              .filter(F.col("position") <= limit))
    return ranked.select(*SNAP, F.col("position").cast("bigint").alias("position"), "path", "name",
                         F.lit(metric).alias("primary_metric"), F.col(metric).alias("primary_value"),
                         "lines", "code", "complexity", "total")


def signal_flags(hotspots: DataFrame) -> DataFrame:
    """which signals of a hotspot are active."""
    out = hotspots
    for k, t in SIGNAL_ACTIVE.items():
        out = out.withColumn(f"{k}_active", F.col(f"{k}_signal") >= F.lit(t))
    return out


def files_by_path(nodes: DataFrame) -> DataFrame:
    """Every file in path order."""
    return nodes.filter(F.col("kind") == "file").orderBy("repo", "snapshot_id", "path")
