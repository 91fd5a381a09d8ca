"""Derived tables shared by several queries of one session.

Some queries start from the same expensive derived table (the strongly
connected components of a dependency graph feed nine reports, the monthly
directory tree eight). Such a table is computed once per Spark application
and input location and reused by the later queries.

Shared tables are written as columnar files to the session's shared folder: they take
no executor memory from the queries that read them, and a lost executor loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codehealth.session import saved

_TABLES: dict[tuple[str, str], DataFrame] = {}


def _app(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect session
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def materialized(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    slot = (_app(spark), key)
    if slot not in _TABLES:
        _TABLES[slot] = saved(build())
    return _TABLES[slot]


def clear() -> None:
    """Forget every shared table (the next query recomputes what it needs)."""
    _TABLES.clear()
