"""Directory tree of a snapshot: per-node stats and issue roll-ups.

Every file contribution (stats rows, and per-kind issue counts) is exploded
to the file and each of its ancestor directories in one array expression, and
all contributions are summed with a single ``groupBy(snapshot, node)``. The
root directory receives every file of a snapshot; map-side partial
aggregation collapses it to one row per map task before the shuffle, so the
hot key costs nothing extra. There is no recursion and no per-node loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codehealth.functions.paths import ancestor_ids, base_name, normalize_path, parent_path, repo_relative_path, within_root
from codehealth.session import checkpoint_dir

SNAP = ["repo", "snapshot_id"]
ISSUE_KEYS = ("unused", "duplication", "cycles")
STAT_KEYS = ("lines", "code", "complexity")


def contributions(stats: DataFrame | None, issues: DataFrame | None) -> DataFrame:
    """One long table of contributions.

    ``stats``: (repo, snapshot_id, path, lines, code, complexity), repeats allowed.
    ``issues``: (repo, snapshot_id, path, key, count) with key in ISSUE_KEYS;
    non-positive counts are ignored (they create no node).
    """
    parts = []
    if stats is not None:
        parts.append(stats.select(*SNAP, "path", *[F.col(k).cast("bigint").alias(k) for k in STAT_KEYS],
                                  F.lit(1).alias("stat_rows")))
    if issues is not None:
        iss = issues.filter(F.col("count") > 0)
        parts.append(iss.select(*SNAP, "path", *[
            F.when(F.col("key") == k, F.col("count")).otherwise(F.lit(0)).cast("bigint").alias(k)
            for k in ISSUE_KEYS], F.lit(0).alias("stat_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for k in (*STAT_KEYS, *ISSUE_KEYS):  # one kind of input alone
        if k not in out.columns:
            out = out.withColumn(k, F.lit(0).cast("bigint"))
    return out.fillna(0, subset=[*STAT_KEYS, *ISSUE_KEYS, "stat_rows"])


def contributions_wide(rows: DataFrame) -> DataFrame:
    """U1 when each row already carries stats and issue counts of one file:
    one pass over the source instead of a union of two projections of it."""
    return rows.select(*SNAP, "path", *[F.col(k).cast("bigint").alias(k) for k in STAT_KEYS],
                       *[F.greatest(F.col(k).cast("bigint"), F.lit(0)).alias(k) for k in ISSUE_KEYS],
                       F.lit(1).alias("stat_rows"))


def issues_long(df: DataFrame) -> DataFrame:
    """Wide per-file issue columns (unused, duplication, cycles) -> long rows."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("bigint").alias("count"))
                                  for k in ISSUE_KEYS]))
    return df.select(*SNAP, "path", stacked.alias("kv")).select(*SNAP, "path", "kv.key", "kv.count")


def _repo_path(cwd: str | None):
    return repo_relative_path(F.col("path"), cwd) if cwd else normalize_path(F.col("path"))


def build_tree(contrib: DataFrame, root: str = "src", cwd: str | None = None) -> DataFrame:
    """A10 + J1: roll contributions up to every ancestor.

    Returns one row per (repo, snapshot_id, node): path, name, kind, parent,
    depth, files, lines, code, complexity, unused, duplication, cycles, total.
    ``files`` is 1 on a file with any stats row, and the number of stats rows
    below a directory (a file listed twice counts twice there); a file known
    only from issues exists with files = 0.
    """
    c = contrib.withColumn("path", _repo_path(cwd)).filter((F.col("path") != "") & within_root(F.col("path"), root))
    exploded = c.select("*", F.posexplode(ancestor_ids(F.col("path"), root)).alias("pos", "node"))
    agg = exploded.groupBy(*SNAP, "node").agg(
        F.max(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("is_file"),
        F.max(F.when((F.col("pos") == 0) & (F.col("stat_rows") > 0), 1).otherwise(0)).alias("own_file"),
        F.sum(F.when(F.col("pos") > 0, F.col("stat_rows")).otherwise(0)).alias("below_files"),
        *[F.sum(k).alias(k) for k in STAT_KEYS],
        *[F.sum(k).alias(k) for k in ISSUE_KEYS],
    )
    kind = F.when(F.col("is_file") == 1, F.lit("file")).otherwise(F.lit("dir"))
    return agg.select(
        *SNAP,
        F.col("node").alias("path"),
        base_name(F.col("node")).alias("name"),
        kind.alias("kind"),
        parent_path(F.col("node"), root).alias("parent"),
        (F.col("own_file") + F.col("below_files")).cast("bigint").alias("files"),
        *[F.col(k) for k in STAT_KEYS],
        *[F.col(k) for k in ISSUE_KEYS],
        (F.col("unused") + F.col("duplication") + F.col("cycles")).alias("total"),
    )


def attach_dependency(tree: DataFrame, deps: DataFrame, root: str = "src", cwd: str | None = None) -> DataFrame:
    """J1 (last step): per-file dependency info joined to the tree.

    ``deps``: (repo, snapshot_id, path, dependencies, dependents, instability,
    in_cycle). Files known only from the dependency graph become file nodes
    with zero stats, together with the directories above them that the tree
    does not have yet.
    """
    d = (deps.withColumn("path", _repo_path(cwd))
         .filter((F.col("path") != "") & within_root(F.col("path"), root)))
    above = d.select(*SNAP, F.posexplode(ancestor_ids(F.col("path"), root)).alias("pos", "node"))
    missing = (above.groupBy(*SNAP, "node").agg(F.min("pos").alias("pos"))
               .join(tree.select(*SNAP, F.col("path").alias("node")), [*SNAP, "node"], "left_anti"))
    zero = [F.lit(0).cast("bigint").alias(k) for k in (*STAT_KEYS, *ISSUE_KEYS, "total")]
    added = missing.select(*SNAP, F.col("node").alias("path"), base_name(F.col("node")).alias("name"),
                           F.when(F.col("pos") == 0, F.lit("file")).otherwise(F.lit("dir")).alias("kind"),
                           parent_path(F.col("node"), root).alias("parent"),
                           F.lit(0).cast("bigint").alias("files"), *zero)
    return tree.unionByName(added).join(d, on=[*SNAP, "path"], how="left")


def child_order(tree: DataFrame, collation: str | None = None) -> DataFrame:
    """Ordered children of every directory: directories first, then path.

    Paths are ordered by code points, or with ``collation`` (``UNICODE`` for display, where
    ``_x``, ``a``, ``B`` come in this order) by it and then by code points.

    A directory may hold a third of all files, so children are not ranked in one window
    per directory: they are put into ranges of the whole order, which cut a large
    directory into as many parts as it needs whatever its names are. Children are ranked
    in their part, and a running sum over the few parts of a directory gives each part's
    offset. The ranges come from a sample, so they are written once (checkpoint) and read twice.
    """
    children = (tree.filter(F.col("parent").isNotNull())
                .select(*SNAP, "parent", F.when(F.col("kind") == "dir", 0).otherwise(1).alias("ko"), "path", "kind"))
    checkpoint_dir(tree.sparkSession)
    order = ["ko", *([F.collate("path", collation)] if collation else []), "path"]
    placed = (children.repartitionByRange(*SNAP, "parent", *order)
              .withColumn("part", F.spark_partition_id()).checkpoint())
    key = [*SNAP, "parent", "part"]
    local = placed.withColumn("local", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*SNAP, "parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return local.join(offsets, key).select(*SNAP, "parent", F.col("path").alias("child"), "kind",
                                            (F.col("offset") + F.col("local")).cast("bigint").alias("position"))


def node_counts(tree: DataFrame, root: str = "src") -> DataFrame:
    """Node count and root id per snapshot."""
    return tree.groupBy(*SNAP).agg(F.count(F.lit(1)).alias("node_count"),
                                   F.count_if(F.col("kind") == "file").alias("file_nodes"),
                                   F.count_if(F.col("kind") == "dir").alias("dir_nodes")) \
        .withColumn("root_id", F.lit(root))
