"""Snapshot history store: read, select, save, prune.

Two layouts are supported:

* the reference's JSON layout ``<base>/<repo>/snapshots/<id>/summary.json``
  (plus ``report.md``, ``tree.json`` and ``artifacts/<id>.json``), read in parallel with
  ``spark.read.json`` — one record per file, malformed files kept as a
  corrupt-record row so they can be skipped explicitly; ``save_bundles`` writes it;
* partitioned tables ``<base>/<table>/repo=…/snapshot_id=…`` written by
  ``save_tables`` with dynamic partition overwrite (re-saving an id replaces
  it, as the reference does).
"""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from codehealth.operators.history import METRIC_KINDS
from codehealth.params import SNAPSHOT_VERSION

SNAP = ["repo", "snapshot_id"]

# functions run on executors travel as a whole: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- schemas --------------------------------------------------------------------------
METRICS = T.StructType([T.StructField(n, t) for n, t in (
    ("kind", T.StringType()),
    ("totalFiles", T.LongType()), ("totalLines", T.LongType()), ("totalCode", T.LongType()),
    ("totalComplexity", T.LongType()), ("totalBlanks", T.LongType()), ("totalComments", T.LongType()),
    ("unusedFiles", T.LongType()), ("unusedExports", T.LongType()), ("unusedTypes", T.LongType()),
    ("unusedDependencies", T.LongType()), ("totalIssues", T.LongType()),
    ("totalClones", T.LongType()), ("duplicatedLinesPercent", T.DoubleType()),
    ("duplicatedTokensPercent", T.DoubleType()),
    ("totalModules", T.LongType()), ("totalDependencies", T.LongType()), ("cycleCount", T.LongType()))])
CHECK = T.StructType([T.StructField("name", T.StringType()), T.StructField("status", T.StringType()),
                      T.StructField("summary", T.StringType()), T.StructField("duration", T.LongType()),
                      T.StructField("metrics", METRICS)])
GIT = T.StructType([T.StructField("commit", T.StringType()), T.StructField("branch", T.StringType()),
                    T.StructField("dirty", T.BooleanType()), T.StructField("message", T.StringType())])
ARTIFACT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "checkName", "format", "path")])
SUMMARY = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("git", GIT),
    T.StructField("duration", T.LongType()), T.StructField("checks", T.ArrayType(CHECK)),
    T.StructField("artifacts", T.ArrayType(ARTIFACT)),
    T.StructField("tree", T.StructType([T.StructField("path", T.StringType()),
                                        T.StructField("rootId", T.StringType()),
                                        T.StructField("nodeCount", T.LongType())])),
    T.StructField("_bad", T.StringType()),
])
_LONGS = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
TREE = T.StructType([T.StructField("nodes", T.MapType(T.StringType(), T.StructType([
    T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("stats", _LONGS("files", "lines", "code", "complexity")),
    T.StructField("issues", _LONGS("total", "unused", "duplication", "cycles")),
    T.StructField("dependency", T.StructType([
        T.StructField("dependencies", T.LongType()), T.StructField("dependents", T.LongType()),
        T.StructField("instability", T.DoubleType()), T.StructField("inCycle", T.BooleanType())]))])))])
COMMIT_FIELDS = ("sha", "short_sha", "ts_raw", "subject")
# -----------------------------------------------------------------------------------------

_FILE_RX = r"/([^/]+)/snapshots/([^/]+)/(.+)$"


def _keys(path_col):
    return (F.regexp_extract(path_col, _FILE_RX, 1).alias("repo"),
            F.regexp_extract(path_col, _FILE_RX, 2).alias("snapshot_id"))


def list_files(spark: SparkSession, base: str, name: str = "*") -> DataFrame:
    """(path, repo, snapshot_id, rel) of the files of every bundle whose names fit, from
    the listing alone: no file is opened."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name)
             .load(f"{base.rstrip('/')}/*/snapshots/*").select("path"))
    return found.select("path", *_keys(F.col("path")), F.regexp_extract("path", _FILE_RX, 3).alias("rel"))


def read_summaries_raw(spark: SparkSession, base: str) -> DataFrame:
    """Every ``summary.json`` under ``base`` as one row (malformed -> ``_bad``)."""
    df = (spark.read.schema(SUMMARY).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_bad")
          .json(f"{base.rstrip('/')}/*/snapshots/*/summary.json"))
    return df.select(*_keys(F.col("_metadata.file_path")), "*")


def _newest(rows: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.desc("snapshot_id"))
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")


def load_summaries(spark: SparkSession, base: str, limit: int | None = None,
                   filter_first: bool = False) -> DataFrame:
    """Snapshots newest first (by directory name), at most ``limit`` per
    repository, malformed and non-version-3 summaries skipped.

    As in the reference the limit is applied to directory names *before* the
    validity filter, so fewer than ``limit`` may come back, and only the chosen files
    are opened: tasks fetch them, no list of paths passes through the driver.
    ``filter_first=True`` reads all and filters first instead.
    """
    valid = F.col("_bad").isNull() & (F.col("version") == SNAPSHOT_VERSION)
    if limit is None or filter_first:
        rows = read_summaries_raw(spark, base).filter(valid).drop("_bad")
        return rows if limit is None else _newest(rows, limit)
    listed = list_files(spark, base, "summary.json").filter(F.col("rel") == "summary.json")
    chosen = _newest(listed, limit).select(*SNAP, F.lit(None).cast("string").alias("id"), "rel")
    held = chosen.mapInArrow(_reader(base), HELD)
    parsed = held.select(*SNAP, F.from_json("raw", SUMMARY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("s"))
    return parsed.select(*SNAP, "s.*").filter(valid).drop("_bad")


def load_latest(spark: SparkSession, base: str) -> DataFrame:
    """The newest snapshot per repository (possibly none, see S1)."""
    return load_summaries(spark, base, limit=1)


def checks_of(summaries: DataFrame) -> DataFrame:
    """Summaries -> check rows with their position (first match wins)."""
    c = summaries.select(*SNAP, "timestamp", F.posexplode("checks").alias("check_idx", "c"))
    return c.select(*SNAP, "timestamp", "check_idx", "c.name", "c.status", "c.summary",
                    F.col("c.duration").alias("duration_ms"), "c.metrics")


def _first_of_kind(summaries: DataFrame) -> DataFrame:
    """P6 on stored summaries: the first metric of each kind."""
    c = checks_of(summaries).filter(F.col("metrics.kind").isNotNull())
    return c.groupBy(*SNAP, F.col("metrics.kind").alias("kind")).agg(F.min_by("metrics", "check_idx").alias("m"))


def _pick(kind: str, field: str):
    return F.max(F.when(F.col("kind") == kind, F.col(f"m.{field}")))


def trend_from_summaries(summaries: DataFrame) -> DataFrame:
    """A13 + P6 on stored summaries: first metric of each kind, all four needed."""
    agg = _first_of_kind(summaries).groupBy(*SNAP).agg(
        _pick("stats-overview", "totalLines").alias("lines"),
        _pick("stats-overview", "totalComplexity").alias("complexity"),
        _pick("unused", "totalIssues").alias("unused"),
        _pick("duplicates", "duplicatedLinesPercent").alias("duplication"),
        _pick("cycles", "cycleCount").alias("cycles"),
        F.count_distinct(F.when(F.col("kind").isin(*METRIC_KINDS), F.col("kind"))).alias("kinds"))
    full = F.col("kinds") == len(METRIC_KINDS)  # a run may carry further kinds
    return agg.select(*SNAP, *[F.when(full, F.col(k)).alias(k)
                               for k in ("lines", "complexity", "unused", "duplication", "cycles")])


def health_metrics(summaries: DataFrame) -> DataFrame:
    """The input of the health score (A14) from stored summaries, one row per snapshot; NULL
    where a check left no metric."""
    agg = _first_of_kind(summaries).groupBy(*SNAP).agg(
        _pick("stats-overview", "totalFiles").alias("total_files"),
        _pick("stats-overview", "totalCode").alias("total_code"),
        _pick("stats-overview", "totalComplexity").alias("total_complexity"),
        _pick("unused", "totalIssues").alias("total_issues"),
        _pick("duplicates", "duplicatedLinesPercent").alias("duplicated_lines_percent"))
    return summaries.select(*SNAP, F.try_to_timestamp("timestamp").alias("ts")).join(agg, SNAP, "left")


def tree_nodes(bundles: DataFrame) -> DataFrame:
    """The nodes of the stored trees, in the columns of ``tree.attach_dependency``."""
    nodes = bundles.select(*SNAP, F.explode(F.map_values(F.from_json("tree_json", TREE)["nodes"])).alias("n"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c.split(".")[-1])
    return nodes.select(*SNAP, "n.*").select(
        *SNAP, "path", "name", "kind", *[number(f"stats.{c}") for c in ("files", "lines", "code", "complexity")],
        *[number(f"issues.{c}") for c in ("total", "unused", "duplication", "cycles")],
        "dependency.dependencies", "dependency.dependents", "dependency.instability",
        F.col("dependency.inCycle").alias("in_cycle"))


def _files_at(base: str):
    """The file system that holds ``base``, and its path there."""
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    return fs.FileSystem.from_uri(base.rstrip("/"))


HELD = "repo string, snapshot_id string, id string, rel string, raw string"


def _reader(base: str):
    def run(batches):
        files, root = _files_at(base)
        for batch in batches:
            raw = []
            for row in batch.to_pylist():
                path = f"{root}/{row['repo']}/snapshots/{row['snapshot_id']}/{row['rel']}"
                if files.get_file_info(path).type == fs.FileType.File:
                    with files.open_input_stream(path) as source:
                        raw.append(source.read().decode(errors="replace"))
                else:
                    raw.append(None)
            yield batch.append_column("raw", pa.array(raw, pa.string()))
    return run


def load_bundles(spark: SparkSession, base: str) -> DataFrame:
    """S3 + J5: complete bundles, the columns of S1 and ``report_text``, ``tree_json`` and
    ``artifact_json`` (artifact id -> JSON text).

    A bundle that lacks the report, the tree, the artifact list or a declared artifact,
    or of which the tree or a declared artifact is not JSON, is dropped as a whole.
    """
    summaries = load_summaries(spark, base).filter(F.col("artifacts").isNotNull())
    artifact = F.struct(F.col("a.id").alias("id"), F.col("a.path").alias("rel"))
    declared = summaries.select(*SNAP, F.explode("artifacts").alias("a")).select(*SNAP, artifact.alias("a"))
    fixed = F.array(*[F.struct(F.lit(None).cast("string").alias("id"), F.lit(rel).alias("rel"))
                      for rel in ("report.md", "tree.json")])
    needed = declared.unionByName(summaries.select(*SNAP, F.explode(fixed).alias("a"))).select(*SNAP, "a.*")
    # tasks fetch what is named: Spark's own readers pass over empty files, and an empty report is a report
    held = needed.mapInArrow(_reader(base), HELD)
    usable = F.col("raw").isNotNull() & ((F.col("rel") == "report.md") | F.try_parse_json("raw").isNotNull())
    # a run leaves a handful of artifacts, so a bundle is one row
    whole = held.groupBy(*SNAP).agg(
        F.bool_and(usable).alias("_whole"),
        F.max(F.when(F.col("rel") == "report.md", F.col("raw"))).alias("report_text"),
        F.max(F.when(F.col("rel") == "tree.json", F.col("raw"))).alias("tree_json"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("id").isNotNull(), F.struct("id", "raw"))))
                           ).alias("artifact_json"))
    return summaries.join(whole.filter("_whole").drop("_whole"), SNAP)


def _writer(base: str):
    def run(batches):
        files, root = _files_at(base)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                target = f"{root}/{row['repo']}/snapshots/{row['snapshot_id']}/{row['rel']}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"  # a task that runs again, or twice, replaces the whole file
                with files.open_output_stream(part) as out:
                    out.write(row["raw"].encode())
                files.move(part, target)
            yield pa.RecordBatch.from_pydict({"n": [len(rows)]})
    return run


def save_bundles(bundles: DataFrame, base: str) -> int:
    """Write bundles (the columns that :func:`load_bundles` returns) in the layout that
    S1-S3 read; the same id is replaced. Every task writes its own files, the summaries
    last, so that a bundle is listed only when it is whole. Returns the number of files."""
    named = [f.name for f in SUMMARY.fields if f.name in bundles.columns]
    fixed = F.array(F.struct(F.lit("report.md").alias("rel"), F.col("report_text").alias("raw")),
                    F.struct(F.lit("tree.json").alias("rel"), F.col("tree_json").alias("raw")))
    declared = F.transform(F.coalesce("artifacts", F.array().cast(T.ArrayType(ARTIFACT))), lambda a: F.struct(
        a["path"].alias("rel"), F.try_element_at("artifact_json", a["id"]).alias("raw")))
    parts = bundles.select(*SNAP, F.explode(F.concat(fixed, declared)).alias("p")).select(*SNAP, "p.rel", F.coalesce("p.raw", F.lit("")).alias("raw"))
    heads = bundles.select(*SNAP, F.lit("summary.json").alias("rel"), F.to_json(F.struct(*named)).alias("raw"))
    count = 0
    for rows in (parts, heads):
        count += rows.mapInArrow(_writer(base), "n long").agg(F.sum("n")).first()[0] or 0
    return count


def prune_plan(summaries: DataFrame, max_snapshots: int) -> tuple[DataFrame, DataFrame]:
    """(retained, removed) keeping the newest ``max_snapshots`` ids per
    repository; ``max_snapshots < 1`` keeps everything."""
    if max_snapshots < 1:
        return summaries, summaries.limit(0)
    w = Window.partitionBy("repo").orderBy(F.desc("snapshot_id"))
    ranked = summaries.withColumn("_rank", F.row_number().over(w))
    return (ranked.filter(F.col("_rank") <= max_snapshots).drop("_rank"),
            ranked.filter(F.col("_rank") > max_snapshots).drop("_rank"))


def _deleter(base: str):
    def run(batches):
        files, root = _files_at(base)
        for batch in batches:
            for rel in batch.column("rel").to_pylist():
                if files.get_file_info(f"{root}/{rel}").type == fs.FileType.Directory:  # gone already if the task runs again
                    files.delete_dir(f"{root}/{rel}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})
    return run


def prune_tables(spark: SparkSession, base: str, tables, max_snapshots: int) -> int:
    """S5 on partitioned tables: drop the partitions of removed snapshots.

    Snapshots are told from the listing (no file is opened), and the tasks that hold
    them delete their folders. Returns the number of removed snapshots.
    """
    base = base.rstrip("/")
    folder = r"/(repo=[^/]*)/(snapshot_id=[^/]*)/[^/]+$"
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/{tables[0]}").select(
        F.regexp_extract("path", folder, 1).alias("repo"), F.regexp_extract("path", folder, 2).alias("snapshot_id"))
        .filter(F.col("snapshot_id") != "").distinct())
    _, removed = prune_plan(listed, max_snapshots)
    rel = F.concat_ws("/", F.col("table"), F.col("repo"), F.col("snapshot_id"))
    doomed = removed.withColumn("table", F.explode(F.array(*[F.lit(t) for t in tables]))).select(rel.alias("rel"))
    gone = doomed.mapInArrow(_deleter(base), "n long").agg(F.sum("n")).first()[0] or 0
    return gone // len(tables)


def save_tables(tables: dict[str, DataFrame], base: str) -> None:
    """Write each table partitioned by (repo, snapshot_id); re-saving a
    snapshot id replaces exactly its partitions."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SNAP).parquet(f"{base.rstrip('/')}/{name}")


def read_commit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An exported log of ``sha 0x1F short 0x1F time 0x1F subject`` lines.
    Returns (commits, rejected): rows without sha, short sha or time are rejected."""
    parts = F.split(F.col("value"), "\u001f", 4)
    df = spark.read.text(path).select(*[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(COMMIT_FIELDS)],
                                      F.col("value").alias("line"))
    ok = F.lit(True)
    for n in COMMIT_FIELDS[:3]:
        ok = ok & F.col(n).isNotNull() & (F.col(n) != "")
    commits = (df.filter(ok).withColumn("subject", F.coalesce("subject", F.lit("")))
               .withColumn("ts", F.to_timestamp("ts_raw")).drop("line"))
    return commits, df.filter(~ok).select("line")
