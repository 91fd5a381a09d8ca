"""Dashboard dataset and report sinks (S12, S13, S14) and file details.

The dashboard's client-side logic (ranges, positions, deltas, clone and
unused-item details) is computed here as ordinary DataFrames and written as
tables, one folder per dataset, partitioned by repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.functions import formatting as fmt
from codehealth.operators import clones, health, history, rankings
from codehealth.operators.unused import KIND_LABELS
from codehealth.sources import reports, store

SNAP = ["repo", "snapshot_id"]


def dashboard_rows(snaps: DataFrame, trend: DataFrame | None = None, node_counts: DataFrame | None = None,
                   health: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """One row per snapshot, oldest first: id, timestamp, label, metrics,
    tree size, health and status counts (all per-snapshot tables, joined on
    the snapshot key)."""
    out = snaps.select(*SNAP, "ts")
    if status is not None:
        out = out.join(status, SNAP, "left")
    if trend is not None:
        out = out.join(trend, SNAP, "left")
    if node_counts is not None:
        out = out.join(node_counts.select(*SNAP, "node_count", "root_id"), SNAP, "left")
    if health is not None:
        out = out.join(health.select(*SNAP, "overall", "trend"), SNAP, "left")
    return (out.withColumn("timestamp", fmt.iso_timestamp(F.col("ts")))
            .withColumn("label", fmt.human_date(F.col("ts"))))


def unused_items(issues: DataFrame, spark=None) -> DataFrame:
    """J4 + F17/F18: per snapshot and file the distinct labels
    '<kind label>: <name or ?>' with ' (line n)' when the line is known;
    'Entire file unused' for a file."""
    spark = spark or issues.sparkSession
    labels = F.broadcast(spark.createDataFrame(list(KIND_LABELS.items()), "kind string, kind_label string"))
    i = issues if "line" in issues.columns else issues.withColumn("line", F.lit(None).cast("bigint"))
    j = i.join(labels, "kind")
    text = F.concat(F.col("kind_label"), F.lit(": "), F.coalesce(F.col("name"), F.lit("?")),
                    F.when(F.col("line").isNotNull(),
                           F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")")))
                    .otherwise(F.lit("")))
    text = F.when(F.col("kind") == "files", F.col("kind_label")).otherwise(text)
    return j.select(*SNAP, "file", text.alias("label")).distinct()


def clone_details(clones_by_file: DataFrame) -> DataFrame:
    """J3 + F16: clone rows per file with line-range text."""
    return clones_by_file.select(
        *SNAP, "path", "other_path", "lines",
        fmt.line_range(F.col("self_start"), F.col("self_end")).alias("self_range"),
        fmt.line_range(F.col("other_start"), F.col("other_end")).alias("other_range"))


def write_results_json(checks: DataFrame, path: str) -> None:
    """Name, status, summary, duration, output and metrics per check."""
    cols = [c for c in ("repo", "snapshot_id", "name", "status", "summary", "duration_ms", "output", "metrics")
            if c in checks.columns]
    checks.select(*cols).write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], base: str, partition_by=("repo",)) -> None:
    """Write every dataset as parquet under ``base/<name>``."""
    for name, df in tables.items():
        # only the partitions that are written are replaced
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        keys = [k for k in partition_by if k in df.columns]
        if keys:
            w = w.partitionBy(*keys)
        w.parquet(f"{base.rstrip('/')}/{name}")


def report_tables(status: DataFrame, checks: DataFrame | None = None, instability: DataFrame | None = None,
                  top: int = 25) -> dict[str, DataFrame]:
    """The tables of the run report: check summary, status counts,
    instability summary and the two instability rankings."""
    from codehealth.operators import depgraph
    out = {"status_counts": status}
    if checks is not None:
        out["check_summary"] = checks.select(*[c for c in ("repo", "snapshot_id", "check_idx", "name", "status",
                                                           "summary", "duration_ms") if c in checks.columns])
    if instability is not None:
        out["instability_summary"] = depgraph.instability_summary(instability)
        out["highly_unstable"] = depgraph.highly_unstable(instability, top)
        out["stable_depended_on"] = depgraph.stable_depended_on(instability, top)
    return out


def stored_datasets(bundles: DataFrame) -> dict[str, DataFrame]:
    """The eight tables of the dashboard from stored bundles (S3): snapshot rows, tree
    nodes, the four rankings of each snapshot, and the details of unused items and clones."""
    tree = store.tree_nodes(bundles)
    metrics = store.health_metrics(bundles)
    rows = dashboard_rows(metrics, trend=store.trend_from_summaries(bundles),
                          health=health.health_scores(metrics, health.tree_file_counts(tree)),
                          status=history.status_counts(store.checks_of(bundles)))
    about = bundles.select(*SNAP, fmt.commit_label(F.col("git.commit"), F.col("git.dirty")).alias("commit"),
                           F.col("git.branch").alias("branch"), F.col("tree.nodeCount").alias("node_count"),
                           F.col("tree.rootId").alias("root_id"))

    def report(name):
        return bundles.select(*SNAP, F.try_element_at("artifact_json", F.lit(name)).alias("raw")).filter("raw is not null")
    # the root of a tree is a directory as others are, but not ranked
    roots = about.select(*SNAP, F.col("root_id").alias("path"))
    return {
        "rows": rows.join(about, SNAP), "tree": tree,
        "largest_files": rankings.top_files_by(tree, "code"),
        "complex_files": rankings.top_files_by(tree, "complexity"),
        "file_hotspots": rankings.file_hotspots(tree),
        "dir_hotspots": rankings.dir_hotspots(tree.join(roots, [*SNAP, "path"], "left_anti"), root=""),
        "unused_items": unused_items(reports.unused_report_items(report("unused"))),
        "clone_details": clone_details(clones.clones_by_file(reports.clone_report_pairs(report("duplicates")))),
    }


def write_dashboard(spark, base: str, out: str) -> None:
    """Write the dashboard tables of every complete bundle under ``base``."""
    bundles = store.load_bundles(spark, base).persist()
    write_tables(stored_datasets(bundles), out)
    bundles.unpersist()
