"""Tree roll-up, hotspots, health and history fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from codehealth.functions import formatting as fmt
from codehealth.operators import health, history, rankings
from codehealth.operators import tree as tr
from codehealth.sources import reports as rp

BUNDLE = {
    "stats-complexity": [{"Name": "TypeScript", "Files": [
        {"Location": "src/a.ts", "Lines": 10, "Code": 7, "Complexity": 3},
        {"Location": "src/nested/b.ts", "Lines": 20, "Code": 13, "Complexity": 4}]}],
    "unused": {"files": ["src/unused.ts"], "issues": [{"file": "src/a.ts", "exports": [{"name": "foo"}]}]},
    "duplicates": {"duplicates": [{"firstFile": {"name": "src/a.ts"}, "secondFile": {"name": "src/nested/b.ts"}}],
                   "statistics": {"total": {"clones": 1, "percentage": 2.4, "percentageTokens": 3.1, "lines": 30}}},
    "cycles": {"modules": [
        {"source": "src/a.ts", "dependencies": [{"resolved": "src/nested/b.ts", "circular": True}],
         "dependents": ["src/nested/b.ts"], "instability": 0.5},
        {"source": "src/nested/b.ts", "dependencies": [{"resolved": "src/a.ts", "circular": True}],
         "dependents": ["src/a.ts"], "instability": 0.5}],
        "summary": {"totalCruised": 2, "totalDependenciesCruised": 2, "violations": [{"name": "no-circular"}]}},
}


def _rep(spark, doc):
    return spark.createDataFrame([("r", "s1", json.dumps(doc))], "repo string, snapshot_id string, raw string")


@pytest.fixture(scope="module")
def bundle_tree(spark):
    stats = rp.scc_files(_rep(spark, BUNDLE["stats-complexity"]))
    un = rp.unused_counts_by_file(_rep(spark, BUNDLE["unused"])).select(
        "repo", "snapshot_id", F.col("file").alias("path"), F.lit("unused").alias("key"),
        F.col("unused").alias("count"))
    du = rp.clone_report_counts_by_file(_rep(spark, BUNDLE["duplicates"])).select(
        "repo", "snapshot_id", "path", F.lit("duplication").alias("key"), F.col("duplication").alias("count"))
    cy = rp.graph_cycle_counts_by_file(_rep(spark, BUNDLE["cycles"])).select(
        "repo", "snapshot_id", "path", F.lit("cycles").alias("key"), F.col("cycles").alias("count"))
    contrib = tr.contributions(stats.select("repo", "snapshot_id", "path", "lines", "code", "complexity"),
                               un.unionByName(du).unionByName(cy))
    tree = tr.build_tree(contrib, root="src")
    deps = rp.graph_instability(_rep(spark, BUNDLE["cycles"]))
    return tr.attach_dependency(tree, deps, root="src").cache()


def _node(tree, path):
    return tree.filter(F.col("path") == path).first()


def test_bundle_root_rollup(bundle_tree):
    root = _node(bundle_tree, "src")
    assert (root.files, root.lines, root.code, root.complexity) == (2, 30, 20, 7)
    assert (root.total, root.unused, root.duplication, root.cycles) == (6, 2, 2, 2)


def test_bundle_file_and_dir_nodes(bundle_tree):
    a = _node(bundle_tree, "src/a.ts")
    assert (a.total, a.unused, a.duplication, a.cycles) == (3, 1, 1, 1)
    assert (a.dependencies, a.dependents, a.instability, a.in_cycle) == (1, 1, 0.5, True)
    nested = _node(bundle_tree, "src/nested")
    assert (nested.total, nested.unused, nested.duplication, nested.cycles) == (2, 0, 1, 1)
    unused = _node(bundle_tree, "src/unused.ts")
    assert unused.kind == "file" and unused.files == 0
    assert bundle_tree.count() == 5  # src, src/a.ts, src/nested, src/nested/b.ts, src/unused.ts


def test_bundle_child_order(bundle_tree):
    kids = tr.child_order(bundle_tree).filter(F.col("parent") == "src").orderBy("position").collect()
    assert [k.child for k in kids] == ["src/nested", "src/a.ts", "src/unused.ts"]


def test_hotspots_on_bundle(bundle_tree):
    files = {r.path: r.score for r in rankings.file_hotspots(bundle_tree, 10).collect()}
    assert files == {"src/nested/b.ts": 87, "src/a.ts": 79, "src/unused.ts": 13}
    dirs = {r.path: r.score for r in rankings.dir_hotspots(bundle_tree, "src", 5).collect()}
    assert dirs == {"src/nested": 100}


def test_health_scores_two_snapshots(spark):
    metrics = spark.createDataFrame([
        ("r", "s1", "2026-03-10 10:00:00", 10, 80, 20, 1, 1.2),
        ("r", "s2", "2026-03-10 11:00:00", 10, 90, 24, 2, 1.5)],
        "repo string, snapshot_id string, ts string, total_files long, total_code long, total_complexity long, "
        "total_issues long, duplicated_lines_percent double").withColumn("ts", F.to_timestamp("ts"))
    counts = spark.createDataFrame([("r", "s2", 2, 0, 2)],
                                   "repo string, snapshot_id string, file_nodes long, oversized_files long, "
                                   "overly_complex_files long")
    rows = {r.snapshot_id: r for r in health.health_scores(metrics, counts).collect()}
    s2 = rows["s2"]
    assert (s2.duplication_score, s2.unused_score, s2.complexity_score, s2.oversized_files_score,
            s2.overly_complex_files_score, s2.overall) == (93, 90, 33, 100, 0, 63)
    s1 = rows["s1"]
    assert (s1.duplication_score, s1.unused_score, s1.complexity_score, s1.oversized_files_score,
            s1.overly_complex_files_score, s1.overall) == (94, 95, 38, 50, 50, 65)
    assert (s1.trend, s2.trend) == (0, -2)


def test_trend_line_text(spark):
    snaps = spark.createDataFrame([("r", "prev", "2026-03-10 10:00:00"), ("r", "cur", "2026-03-11 10:00:00")],
                                  "repo string, snapshot_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    trend = spark.createDataFrame([("r", "prev", 12330, 895, 3, 1.8, 2), ("r", "cur", 12450, 890, 3, 2.1, 1)],
                                  "repo string, snapshot_id string, lines long, complexity long, unused long, "
                                  "duplication double, cycles long")
    got = {r.snapshot_id: r.trend_line for r in history.trend_line(trend, snaps).collect()}
    assert got["prev"] is None
    assert got["cur"] == ("Lines 12,450 (+120) · Complexity 890 (-5) · Unused 3 (=) · "
                          "Duplication 2.1% (+0.3%) · Cycles 1 (-1)")


def test_every_nth_commits(spark):
    revs = ["head", "c1", "c2", "c3", "c4"]
    commits = spark.createDataFrame([("r", i, sha, 100 - i) for i, sha in enumerate(revs)],
                                    "repo string, sha long, short_sha string, ts long")
    got = history.every_nth_commits(commits, 2, 2).orderBy("order").collect()
    assert [r.short_sha for r in got] == ["c4", "c2"]
    with pytest.raises(ValueError):
        history.every_nth_commits(commits, 0, 2)
    short = commits.filter(F.col("sha") < 3)
    assert history.every_nth_commits(short, 2, 2).count() == 0  # not enough history


def test_snapshot_id_and_labels(spark):
    from codehealth.functions import formatting as fmt
    df = spark.createDataFrame([("2026-03-10 17:15:30.123",)], "t string").select(
        F.to_timestamp("t").alias("ts"))
    r = df.select(fmt.snapshot_id(fmt.iso_timestamp(F.col("ts")), F.lit("abc1234")).alias("id"),
                  fmt.human_date(F.col("ts")).alias("label"),
                  fmt.commit_label(F.lit("abc1234"), F.lit(True)).alias("c"),
                  fmt.commit_label(F.lit(None).cast("string"), F.lit(False)).alias("n"),
                  fmt.format_duration(F.lit(1250)).alias("d1"), fmt.format_duration(F.lit(999)).alias("d0"),
                  fmt.compact_number(F.lit(1234)).alias("k")).first()
    assert r.id == "2026-03-10T17-15-30.123Z_abc1234"
    assert r.label == "Tue, Mar 10th 2026"
    assert (r.c, r.n, r.d1, r.d0, r.k) == ("abc1234*", "nogit", "1.3s", "999ms", "1.2k")


def test_previous_snapshot_as_of(spark):
    snaps = spark.createDataFrame([("r", "a", 10), ("r", "b", 20), ("r", "c", 30), ("q", "z", 5)],
                                  "repo string, snapshot_id string, ts long")
    runs = spark.createDataFrame([("r", 1, 20), ("r", 2, 25), ("r", 3, 5), ("q", 4, 6)],
                                 "repo string, run_id long, ts long")
    got = {r.run_id: r.previous_id for r in history.previous_snapshot(runs, snaps).collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: "z"}


def test_display_helpers(spark):
    from codehealth.functions import formatting as fmt
    df = spark.createDataFrame([(85, 0.35, 0.2, 0.1, 2_500_000, 3.0)],
                               "score long, complexity_signal double, size_signal double, issues_signal double, "
                               "big long, d double")
    r = rankings.signal_flags(df).select(
        health.score_tier(F.col("score")).alias("tier"), health.score_tier(F.col("score"), inverted=True).alias("hot"),
        fmt.delta_class("lines", F.col("d")).alias("c_lines"), fmt.delta_class("unused", F.col("d")).alias("c_up"),
        fmt.delta_class("unused", -F.col("d")).alias("c_down"), fmt.compact_number(F.col("big")).alias("m"),
        "complexity_active", "size_active", "issues_active").first()
    assert (r.tier, r.hot, r.c_lines, r.c_up, r.c_down, r.m) == ("low", "high", "neutral", "positive", "negative",
                                                                 "2.5M")
    assert (r.complexity_active, r.size_active, r.issues_active) == (True, False, True)


def test_files_by_path(bundle_tree):
    assert [r.path for r in rankings.files_by_path(bundle_tree).collect()] == [
        "src/a.ts", "src/nested/b.ts", "src/unused.ts"]


def test_trend_needs_four_kinds_and_bears_more(spark):
    from codehealth.operators import history

    kinds = ["stats-overview", "unused", "duplicates", "cycles", "instability", "typecheck"]
    rows = [("r", "s6", k, 1, k, 5, 2.5) for k in kinds] + [("r", "s3", k, 1, k, 5, 2.5) for k in kinds[:3] + kinds[4:]]
    first = spark.createDataFrame(rows, "repo string, snapshot_id string, kind string, check_idx int, name string, count_value bigint, percent_value double")
    got = {r["snapshot_id"]: (r["lines"], r["cycles"]) for r in history.trend_vector(first).collect()}
    assert got == {"s6": (5, 5), "s3": (None, None)}


def test_halves_of_binary_values(spark):
    from codehealth.functions import formatting as fmt
    r = spark.range(1).select(
        fmt.format_percent(F.lit(0.35)).alias("a"), fmt.format_percent(F.lit(0.25)).alias("b"),
        fmt.format_percent(F.lit(99.95)).alias("c"), fmt.format_percent(F.lit(0.0)).alias("d"),
        fmt.format_percent(F.lit(1.0 - 2.0 ** -53)).alias("e"), fmt.format_duration(F.lit(1150)).alias("f"),
        fmt.format_duration(F.lit(1250)).alias("g")).first()
    assert tuple(r) == ("0.3%", "0.3%", "100.0%", "0.0%", "1.0%", "1.1s", "1.3s")


def test_dependency_only_files_join_the_tree(spark):
    stats = spark.createDataFrame([("r", "s", "src/a.ts", 3, 2, 1)],
                                  "repo string, snapshot_id string, path string, lines long, code long, complexity long")
    deps = spark.createDataFrame([("r", "s", "/work/src/x/only.ts", 1, 0, 1.0, False), ("r", "s", "src/a.ts", 0, 1, 0.0, False)],
                                 "repo string, snapshot_id string, path string, dependencies long, dependents long, "
                                 "instability double, in_cycle boolean")
    tree = tr.attach_dependency(tr.build_tree(tr.contributions(stats, None)), deps, cwd="/work")
    got = {r.path: (r.kind, r.parent, r.files, r.lines, r.instability) for r in tree.collect()}
    assert got == {"src": ("dir", None, 1, 3, None), "src/a.ts": ("file", "src", 1, 3, 0.0),
                   "src/x": ("dir", "src", 0, 0, None), "src/x/only.ts": ("file", "src/x", 0, 0, 1.0)}


def test_status_words_belong_to_their_check(spark):
    rows = [(1, "complexity", "pass", "stats-overview", 5, "src/unused.ts"), (2, "duplicates", "pass", None, None, "unused"),
            (3, "duplicates", "pass", None, None, "Found 2 clones"), (4, "unused", "pass", "unused", 0, "Unused files"),
            (5, "unused", "pass", None, None, "Unused files"), (6, "cycles", "fail", None, None, ""),
            (7, "cycles", "skip", "cycles", 3, ""), (8, "cycles", "pass", "cycles", 3, "")]
    checks = spark.createDataFrame([("r", "s", *x) for x in rows],
                                   "repo string, snapshot_id string, check_idx long, name string, status string, kind string, "
                                   "count_value long, output string")
    got = [r.derived_status for r in history.derive_status(checks).orderBy("check_idx").collect()]
    assert got == ["pass", "pass", "warn", "pass", "warn", "fail", "skip", "warn"]


def test_exit_codes_decide_without_metrics(spark):
    rows = [(1, "stats", None, 3), (2, "cycles", None, 1), (3, "cycles", 0, 1), (4, "cycles", None, 0),
            (5, "unused", None, 1), (6, "cycles", None, None), (7, "stats", None, 0)]
    checks = spark.createDataFrame([("r", "s", i, k, "pass", k, n, None, c) for i, k, n, c in rows],
                                   "repo string, snapshot_id string, check_idx long, name string, status string, "
                                   "kind string, count_value long, output string, exit_code int")
    got = [r.derived_status for r in history.derive_status(checks).orderBy("check_idx").collect()]
    assert got == ["fail", "warn", "pass", "pass", "pass", "pass", "pass"]


def test_compact_numbers(spark):
    values = [(-1500.0, "-1.5k"), (12.5, "12.5"), (0.12345, "0.123"), (None, "—"), (999.0, "999"), (1000.0, "1.0k"),
              (-2_500_000.0, "-2.5M"), (0.0, "0"), (999.9996, "1,000"), (999_999.0, "1000.0k"), (-0.5, "-0.5")]
    df = spark.createDataFrame(values, "x double, expected string")
    for r in df.withColumn("got", fmt.compact_number(F.col("x"))).collect():
        assert r.got == r.expected, r
