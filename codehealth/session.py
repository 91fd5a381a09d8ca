"""Session construction and cluster-wide settings.

All jobs share one set of defaults: adaptive execution (runtime broadcast
decisions behind Spark's own size check, partition coalescing, skew-join
splitting), UTC session time and a reliable checkpoint directory for the
iterative graph jobs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. They are runtime SQL confs, so they can also be
# applied to a session the caller built (see ``apply_defaults``).
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Size-checked broadcast: AQE converts a join to broadcast only when the
    # materialised side is below this many bytes; larger sides keep the
    # sort-merge join (with skew splitting).
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Shuffle files go when the query that wrote them ends, so the steps of a loop and the
    # shared tables hold no more than their results. A repeated action writes its own again.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def get_spark(master: str | None = None, app: str = "codehealth",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    Master and shuffle partitions are left to spark-submit unless they are given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (builder
               .config("spark.driver.memory", os.environ.get("CODEHEALTH_DRIVER_MEMORY", "16g"))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # delete checkpoint files of loop steps once their DataFrames are gone
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_defaults(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint directory.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``.
    Only when nothing is configured and the master is local a fresh local folder is
    set; a cluster without a shared folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="codehealth-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as columnar files in the session's shared folder, and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
