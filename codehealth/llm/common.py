"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import codehealth
from codehealth.session import checkpoint_dir


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named, once what it held is used up."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Memo(dict):
    """A bounded memo: ``memo[key]`` computes a missing value once.

    At ``limit`` entries it starts anew and keeps the full one to look things up in
    until the next time, and texts of more than ``longest`` characters are not kept, so
    memory stays bounded on any input and frequent keys stay.
    """

    def __init__(self, compute, limit: int, longest: int | None = None):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        self.before: dict = {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.compute(key)
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Let the Python workers import this package: its sources go to them once per application."""
    spark = spark or SparkSession.getActiveSession()
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(codehealth.__file__).parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="codehealth-code-"))  # read by the driver's file server alone
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/codehealth.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
