"""Source files straight from a directory tree.

``binaryFile`` lists and reads files in parallel (one row per file); the
extension allow-list is pushed into the listing with ``pathGlobFilter`` so
other files are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.params import DEFAULT_EXTENSIONS


def scan_source_files(spark: SparkSession, root: str, repo: str, snapshot_id: str,
                      extensions=DEFAULT_EXTENSIONS, src: str = "src") -> DataFrame:
    """(repo, snapshot_id, path, language, content) for files under ``root``;
    ``path`` is relative to ``root`` and must lie under ``src``."""
    base = root.rstrip("/")
    glob = "*.{" + ",".join(extensions) + "}"
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).load(base))
    rel = F.regexp_replace(F.col("path"), r"^(file:)?" + re.escape(base) + "/", "")
    out = df.select(F.lit(repo).alias("repo"), F.lit(snapshot_id).alias("snapshot_id"), rel.alias("path"),
                    F.substring_index(rel, ".", -1).alias("language"),
                    F.decode(F.col("content"), "UTF-8").alias("content"))
    if src not in (".", ""):
        out = out.filter((F.col("path") == src) | F.col("path").startswith(src + "/"))
    return out
