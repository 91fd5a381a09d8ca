"""Registered queries against their DuckDB oracle on the smallest tables
(one query per operator family; the full set runs in scripts/check_parity.py)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_parity import _kind, _rows  # noqa: E402
from codehealth.sources.testdata import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
FAMILY = ["a1_language_overview", "c5_clones", "a10_tree_rollup", "t5_file_hotspots", "a14_health_trend",
          "f9_trend_line", "w7_every_nth_commits", "g1_circular_edges", "c10_unused_files", "a3_unused_metrics",
          "c18_churn_hotspots", "s14_dashboard_rows", "s3_bundles", "s5_retained_snapshots", "a11_child_order",
          "c1_annotated_line_stats", "c7_annotated_cross_folder", "c8_annotated_strict", "s7_unused_report_metrics"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAMILY)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(o_cols)
    s_types = {f.name: _kind(f.dataType.simpleString()) for f in sdf.schema.fields}
    o_types = {d[0]: _kind(str(d[1])) for d in res.description}
    assert s_types == o_types
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(o_cols, res.fetchall())


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"language", "files", "lines", "position"} <= set(df.columns)


def test_every_query_has_oracle():
    from codehealth.plans.catalog import QUERIES
    from codehealth.plans.oracle import ORACLE

    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
