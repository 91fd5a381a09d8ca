"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables through the adapters and runs one
operator family on them; the matching DuckDB statement lives in
``codehealth.plans.oracle`` under the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.functions import formatting as fmt
from codehealth.operators import churn as ch
from codehealth.operators import clones as cl
from codehealth.operators import corpus
from codehealth.operators import depgraph as g
from codehealth.operators import health, rankings
from codehealth.operators import history as hist
from codehealth.operators import tree as tree_ops
from codehealth.operators import unused as un
from codehealth.params import CloneParams, Rule, StatsParams
from codehealth.plans import dashboard as dash
from codehealth.session import checkpoint_dir
from codehealth.sources import reports as rp
from codehealth.sources import store
from codehealth.sources import testdata as td
from codehealth.streaming import snapshots as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _stats(spark, d):
    return corpus.line_stats(td.source_files(spark, d))


# ---- corpus -------------------------------------------------------------------
@query("c1_line_stats")
def q_c1(spark, d):
    return _stats(spark, d).select("repo", "snapshot_id", "path", "language", "lines", "blanks",
                                   "comments", "code", "complexity", "bytes")


@query("c1_lexed_line_stats")
def q_c1_lexed(spark, d):
    return corpus.line_stats(td.lexed_files(spark, d)).select("repo", "path", "language", "lines", "blanks", "comments",
                                                              "code")


@query("a1_language_overview")
def q_a1(spark, d):
    return corpus.language_overview(_stats(spark, d))


@query("a1_overview_totals")
def q_a1_totals(spark, d):
    return corpus.overview_totals(_stats(spark, d))


@query("t1_top_complexity")
def q_t1(spark, d):
    return corpus.top_files(_stats(spark, d), "complexity", 25)


@query("t2_top_lines")
def q_t2(spark, d):
    return corpus.top_files(_stats(spark, d), "lines", 25)


@query("c2_drop_duplicate_files")
def q_c2(spark, d):
    return corpus.drop_duplicate_files(td.source_files(spark, d))


@query("c3_minified_generated")
def q_c3(spark, d):
    return corpus.minified_or_generated(td.source_files(spark, d))


@query("c4_dryness")
def q_c4(spark, d):
    return corpus.dryness(td.source_files(spark, d))


@query("c16_cocomo")
def q_c16(spark, d):
    return corpus.cocomo(_stats(spark, d))


@query("p2_filtered_stats")
def q_p2(spark, d):
    params = StatsParams(exclude=("**/de/", "**/*.test.*"), exclude_dir=("src3",),
                         large_line_count=40, large_byte_count=100000)
    return corpus.apply_stats_filters(_stats(spark, d), params).select(
        "repo", "snapshot_id", "path", "lines", "bytes")


# ---- tree, rankings and health over the monthly file history --------------------


def history_tree(spark, d):
    """The monthly directory tree; materialised once per session because
    several reports read it twice (rows and per-snapshot maxima)."""
    from codehealth.plans.materialize import materialized

    def build():
        return tree_ops.build_tree(tree_ops.contributions_wide(td.file_history(spark, d)), root=td.SOURCE_ROOT)
    return materialized(spark, f"history_tree:{d}", build)


@query("a10_tree_rollup")
def q_a10(spark, d):
    return history_tree(spark, d)


@query("a11_child_order")
def q_a11(spark, d):
    return tree_ops.child_order(history_tree(spark, d))


@query("a11_display_order")
def q_a11_display(spark, d):
    return tree_ops.child_order(tree_ops.build_tree(tree_ops.contributions(td.named_files(spark, d), None)), "UNICODE")


@query("a12_node_counts")
def q_a12(spark, d):
    return tree_ops.node_counts(history_tree(spark, d), root=td.SOURCE_ROOT)


@query("t5_file_hotspots")
def q_t5(spark, d):
    return rankings.file_hotspots(history_tree(spark, d), limit=10)


@query("t6_dir_hotspots")
def q_t6(spark, d):
    return rankings.dir_hotspots(history_tree(spark, d), root=td.SOURCE_ROOT, limit=5)


@query("t7_largest_files")
def q_t7(spark, d):
    return rankings.top_files_by(history_tree(spark, d), "code", 10)


@query("t8_most_complex_files")
def q_t8(spark, d):
    return rankings.top_files_by(history_tree(spark, d), "complexity", 10)


@query("a14_health_trend")
def q_a14(spark, d):
    tree = history_tree(spark, d)
    return health.health_scores(td.snapshot_metrics_from_tree(tree), health.tree_file_counts(tree))


# ---- history over daily check results ---------------------------------------------


def _checks(spark, d):
    return td.check_results(spark, d)


def _trend(spark, d):
    return hist.trend_vector(hist.first_metrics(_checks(spark, d)))


@query("a2_status_counts")
def q_a2(spark, d):
    return hist.status_counts(_checks(spark, d))


@query("p6_first_metric")
def q_p6(spark, d):
    return hist.first_metrics(_checks(spark, d))


@query("a13_trend_vector")
def q_a13(spark, d):
    return _trend(spark, d)


@query("w1_metric_deltas")
def q_w1(spark, d):
    return hist.metric_deltas(_trend(spark, d), hist.snapshots(_checks(spark, d)))


@query("w1_streamed_deltas")
def q_w1_streamed(spark, d):
    """The trend rows reach a stream in several files, not in the order of time."""
    base = f"{checkpoint_dir(spark)}/deltas-{uuid.uuid4().hex}"
    rows = _trend(spark, d).join(hist.snapshots(_checks(spark, d)).select("repo", "snapshot_id", "ts"), ["repo", "snapshot_id"])
    rows.repartition(4, F.xxhash64("snapshot_id")).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream.start_deltas(arriving, base, f"{base}/state").awaitTermination()
    return stream.current_rows(spark, base)


@query("f9_trend_line")
def q_f9(spark, d):
    return hist.trend_line(_trend(spark, d), hist.snapshots(_checks(spark, d)))


@query("a15_snapshot_range")
def q_a15(spark, d):
    return hist.snapshot_range(hist.snapshots(_checks(spark, d)))


@query("w6_positions")
def q_w6(spark, d):
    return hist.positions(hist.snapshots(_checks(spark, d)))


@query("w5_last_n")
def q_w5(spark, d):
    return hist.last_n(hist.snapshots(_checks(spark, d)))


@query("t10_history_listing")
def q_t10(spark, d):
    return hist.history_listing(hist.snapshots(_checks(spark, d)), _trend(spark, d))


@query("p7_derived_status")
def q_p7(spark, d):
    return hist.derive_status(_checks(spark, d))


@query("p7_exit_codes")
def q_p7_exit(spark, d):
    """Checks of which some lost their metrics and some ended with a code other than 0."""
    c = _checks(spark, d)
    return hist.derive_status(
        c.withColumn("count_value", F.when(F.col("check_idx") % 3 > 0, F.col("count_value")))
        .withColumn("status", F.lit("pass")).withColumn("exit_code", F.col("check_idx") % 4))


@query("w7_short_histories")
def q_w7_short(spark, d):
    return hist.short_histories(td.commits(spark, d), count=3, every=2)


@query("f10_commit_labels")
def q_f10(spark, d):
    return td.commits(spark, d).select("repo", "sha", fmt.commit_label(
        F.when(F.col("sha") % 5 > 0, F.col("short_sha")), F.col("subject") == "fix").alias("label"))


@query("f12_score_tiers")
def q_f12(spark, d):
    """tiers of the health score and the direction of its trend."""
    return q_a14(spark, d).select(
        "repo", "snapshot_id", "overall", health.score_tier(F.col("overall")).alias("tier"),
        health.score_tier(F.col("overall"), inverted=True).alias("heat"),
        fmt.delta_class("health", F.col("trend")).alias("direction"))


@query("f14_signal_flags")
def q_f14(spark, d):
    return rankings.signal_flags(q_t5(spark, d)).select(
        "repo", "snapshot_id", "path", "complexity_active", "size_active", "issues_active")


@query("f15_compact_numbers")
def q_f15(spark, d):
    balance = F.col("c_acctbal").cast("double")
    return td.read(spark, d, "customer").select(
        "c_custkey", fmt.compact_number(balance).alias("balance"),
        fmt.compact_number(balance * F.col("c_custkey")).alias("weighted"),
        fmt.compact_number(F.nullif(F.col("c_custkey") % 7, F.lit(0))).alias("small"))


@query("t9_files_by_path")
def q_t9(spark, d):
    return rankings.files_by_path(history_tree(spark, d)).select("repo", "snapshot_id", "path", "lines", "code",
                                                                 "complexity", "total")


@query("w7_every_nth_commits")
def q_w7(spark, d):
    return hist.every_nth_commits(td.commits(spark, d), count=3, every=2)


@query("p9_snapshot_ids")
def q_p9(spark, d):
    c = td.commits(spark, d)
    return c.select("repo", "sha",
                    fmt.snapshot_id(fmt.iso_timestamp(F.col("ts")), F.col("short_sha")).alias("snapshot_id"),
                    fmt.commit_label(F.col("short_sha"), F.col("subject") == "fix").alias("commit_label"))


# ---- dependency graph over part sequences --------------------------------------------


def _graph(spark, d):
    return td.dep_edges(spark, d), td.modules(spark, d)


def _circular(spark, d):
    from codehealth.plans.materialize import materialized
    return materialized(spark, f"circular_edges:{d}", lambda: g.circular_edges(td.dep_edges(spark, d)))


def _by_file(spark, d):
    e, m = _graph(spark, d)
    return g.instability_by_file(g.coupling(e, m), _circular(spark, d))


def _circular_paths(spark, d):
    _, m = _graph(spark, d)
    return g.with_paths(_circular(spark, d), m)


@query("g2_coupling")
def q_g2(spark, d):
    e, m = _graph(spark, d)
    return g.coupling(e, m)


@query("g1_circular_edges")
def q_g1(spark, d):
    return _circular_paths(spark, d).select("repo", "snapshot_id", "src", "dst", "src_path", "dst_path")


@query("a16_instability_by_file")
def q_a16(spark, d):
    return _by_file(spark, d).select("repo", "snapshot_id", "node", "path", "dependencies", "dependents", "instability", "in_cycle")


@query("a6_instability_summary")
def q_a6(spark, d):
    return g.instability_summary(_by_file(spark, d))


@query("t3_highly_unstable")
def q_t3(spark, d):
    return g.highly_unstable(_by_file(spark, d), 25).select(
        "repo", "snapshot_id", "node", "path", "dependencies", "dependents", "instability", "in_cycle", "position")


@query("t4_stable_depended_on")
def q_t4(spark, d):
    return g.stable_depended_on(_by_file(spark, d), 25).select(
        "repo", "snapshot_id", "node", "path", "dependencies", "dependents", "instability", "in_cycle", "position")


@query("g6_violations")
def q_g6(spark, d):
    return g.violations(_circular_paths(spark, d), "error")


@query("a9_cycle_counts")
def q_a9(spark, d):
    return g.cycle_counts_by_file(_circular_paths(spark, d))


@query("a5_cycle_metrics")
def q_a5(spark, d):
    e, m = _graph(spark, d)
    circ = _circular_paths(spark, d)
    # the rule covers a part of the tree, so some snapshots have circular edges but no violation
    broken = g.violations(circ.filter(F.col("src_path").rlike(r"^src/Brand#1")))
    return g.cycle_metrics(m, g.with_paths(e, m), circ, broken).select(
        "repo", "snapshot_id", "total_modules", "total_dependencies", "circular_edges", "violations", "cycle_count")


@query("g7_reachable")
def q_g7(spark, d):
    return _reached(spark, d)


@query("c10_unused_files")
def q_c10(spark, d):
    return g.unused_files(td.modules(spark, d), _reached(spark, d)).select("repo", "snapshot_id", "node", "path")


@query("g3_scope")
def q_g3(spark, d):
    e, m = _graph(spark, d)
    return g.scope(g.with_paths(e, m), r"^src/Brand#1[0-9]?/").select("repo", "snapshot_id", "src_path", "dst_path")


@query("g4_layers")
def q_g4(spark, d):
    e, m = _graph(spark, d)
    return g.collapse_layers(g.with_paths(e, m), r"^src/[^/]+/")


@query("g5_focus")
def q_g5(spark, d):
    e, m = _graph(spark, d)
    return g.focus(g.with_paths(e, m), r"^src/Brand#7/").select("repo", "snapshot_id", "src_path", "dst_path")


@query("p4_filtered_edges")
def q_p4(spark, d):
    e, m = _graph(spark, d)
    return g.filter_edges(g.with_paths(e, m), include_only="^src", exclude="^src/Brand#5/",
                          do_not_follow="^src/Brand#4/").select("repo", "snapshot_id", "src_path", "dst_path")


@query("g8_rule_violations")
def q_g8(spark, d):
    e, m = _graph(spark, d)
    return g.rule_violations(g.with_paths(e, m), "same-manufacturer", r"^src/(Brand#\d)", r"^src/$1(\d|/)")


RULES = (
    Rule("same-manufacturer", "warn", from_path=r"^src/(Brand#\d)", to_path="^src/Brand#[1-4]",
         to_path_not=r"^src/$1(\d|/)"),
    Rule("generic-stays-generic", "error", from_path="^src/Brand#5", to_path="^src/Brand#1"),
    Rule("no-circular", "error", circular=True),
    Rule("same-end", "info", from_path=r"(\d)$", to_path="$1$", to_path_not="^src/Brand#[24]"),
    Rule("not-tested", "ignore", from_path="^src/"),
)


def _broken_rules(spark, d):
    e, m = _graph(spark, d)
    flagged = g.with_paths(e, m).join(_circular(spark, d).select("src", "dst", F.lit(True).alias("circular")),
                                      ["src", "dst"], "left")
    return m, g.rule_set_violations(flagged, RULES)


@query("g8_rule_set")
def q_g8_set(spark, d):
    return _broken_rules(spark, d)[1]


@query("g8_rule_summary")
def q_g8_summary(spark, d):
    return g.rule_summary(*_broken_rules(spark, d))


@query("g9_more_unstable")
def q_g9(spark, d):
    e, m = _graph(spark, d)
    return g.more_unstable_violations(g.with_paths(e, m), g.coupling(e, m))


# ---- unused code -----------------------------------------------------------------------


def _unused_parts(spark, d):
    rows = td.export_rows(spark, d)
    ux = un.unused_exports(rows, td.import_rows(spark, d), td.export_entries(spark, d))
    dx = un.duplicate_exports(rows)
    decl, used = td.declared_packages(spark, d), td.used_packages(spark, d)
    ud = un.unused_dependencies(decl, used)
    ul = un.unlisted_dependencies(used, decl)
    ur = un.unresolved_imports(td.page_links(spark, d), td.page_targets(spark, d))
    return ux, dx, ud, ul, ur


def _reached(spark, d):
    from codehealth.plans.materialize import materialized
    return materialized(spark, f"reachable:{d}",
                        lambda: g.reachable(td.dep_edges(spark, d), td.entries(spark, d)))


def _issues(spark, d):
    ux, dx, ud, ul, ur = _unused_parts(spark, d)
    uf = g.unused_files(td.modules(spark, d), _reached(spark, d))
    return un.issue_table(uf, ux, dx, ud, ul, ur)


@query("c11_unused_exports")
def q_c11(spark, d):
    return _unused_parts(spark, d)[0].select("repo", "snapshot_id", "file", "symbol", "kind")


@query("c15_duplicate_exports")
def q_c15(spark, d):
    return un.duplicate_exports(td.export_rows(spark, d))


@query("c12_unused_dependencies")
def q_c12(spark, d):
    return un.unused_dependencies(td.declared_packages(spark, d), td.used_packages(spark, d)).select(
        "repo", "snapshot_id", "package", "kind")


@query("c13_unlisted_dependencies")
def q_c13(spark, d):
    return un.unlisted_dependencies(td.used_packages(spark, d), td.declared_packages(spark, d))


@query("p5_workspace_issues")
def q_p5_workspaces(spark, d):
    return un.workspace_issues(*td.workspaces(spark, d))


@query("p5_strict_issues")
def q_p5_strict(spark, d):
    return un.workspace_issues(*td.workspaces(spark, d), strict=True)


@query("p5_one_workspace")
def q_p5_one(spark, d):
    return un.workspace_issues(*td.workspaces(spark, d), workspace="packages/r1")


@query("c12_manifest_issues")
def q_c12_manifests(spark, d):
    return un.manifest_issues(*td.manifests(spark, d))


@query("a3_manifest_metrics")
def q_a3_manifests(spark, d):
    return un.unused_metrics(un.manifest_issues(*td.manifests(spark, d)))


@query("c14_unresolved_imports")
def q_c14(spark, d):
    return un.unresolved_imports(td.page_links(spark, d), td.page_targets(spark, d)).select(
        "repo", "snapshot_id", "file", "specifier")


@query("a3_unused_metrics")
def q_a3(spark, d):
    return un.unused_metrics(_issues(spark, d))


@query("c9_issue_gate")
def q_c9_issues(spark, d):
    return un.max_issues_gate(q_a3(spark, d), 500).select("repo", "snapshot_id", "total_issues", "exceeds_max_issues")


@query("a7_unused_by_file")
def q_a7(spark, d):
    return un.unused_by_file(_issues(spark, d))


@query("p5_filtered_issues")
def q_p5(spark, d):
    return un.filter_issues(_issues(spark, d), include=("exports", "types", "files", "unresolved"),
                            exclude=("unresolved",), workspace="src")


# ---- churn -------------------------------------------------------------------------------
def _churn(spark, d):
    return ch.churn(td.commits(spark, d), td.touches(spark, d), days=90, subject_regex="^fix")


@query("c17_churn")
def q_c17(spark, d):
    return _churn(spark, d)


@query("c17_monthly_churn")
def q_c17m(spark, d):
    return ch.monthly_churn(td.commits(spark, d), td.touches(spark, d))


@query("c18_churn_hotspots")
def q_c18(spark, d):
    return ch.churn_hotspots(_churn(spark, d), td.repo_files(spark, d), limit=20)


@query("c18_recurring_hotspots")
def q_c18r(spark, d):
    return ch.recurring_hotspots(ch.monthly_churn(td.commits(spark, d), td.touches(spark, d)), top=20)


# ---- clones over the corpus ---------------------------------------------------------------


def _clones(spark, d, **kw):
    return cl.clone_pairs(td.source_files(spark, d), CloneParams(**kw))


@query("c5_clones")
def q_c5(spark, d):
    return _clones(spark, d)


@query("c5_clone_classes")
def q_c5_classes(spark, d):
    return cl.clone_classes(td.source_files(spark, d))


@query("c8_clones_strict")
def q_c8(spark, d):
    return _clones(spark, d, mode="strict")


@query("c8_clones_weak")
def q_c8w(spark, d):
    return _clones(spark, d, mode="weak")


@query("c7_cross_folder_clones")
def q_c7(spark, d):
    return _clones(spark, d, skip_local=True)


@query("a8_clone_counts")
def q_a8(spark, d):
    return cl.clone_counts_by_file(_clones(spark, d))


@query("j3_clones_by_file")
def q_j3(spark, d):
    return cl.clones_by_file(_clones(spark, d))


@query("a4_duplication_totals")
def q_a4(spark, d):
    files = td.source_files(spark, d)
    return cl.duplication_totals(cl.clone_pairs(files, CloneParams()), files)


@query("c9_duplication_gate")
def q_c9_clones(spark, d):
    return cl.threshold_gate(q_a4(spark, d), 1.0).select("repo", "snapshot_id", "duplicated_lines_percent",
                                                         "exceeds_threshold")


@query("f16_clone_lines")
def q_f16(spark, d):
    return _clones(spark, d).select(
        "repo", "snapshot_id", "first_file", "first_start", "second_file",
        fmt.line_range(F.col("first_start"), F.col("first_end")).alias("first_lines"),
        fmt.line_range(F.col("second_start"), F.col("second_end")).alias("second_lines"))


# ---- details and dashboard rows ------------------------------------------------------------


@query("j4_unused_items")
def q_j4(spark, d):
    return dash.unused_items(_issues(spark, d))


@query("s14_dashboard_rows")
def q_s14(spark, d):
    tree = history_tree(spark, d)
    metrics = td.snapshot_metrics_from_tree(tree)
    trend = metrics.select("repo", "snapshot_id", F.col("total_lines").alias("lines"),
                           F.col("total_complexity").alias("complexity"), F.col("total_issues").alias("unused"),
                           F.col("duplicated_lines_percent").alias("duplication"),
                           F.col("cycle_count").alias("cycles"))
    rows = dash.dashboard_rows(metrics, trend=trend, node_counts=tree_ops.node_counts(tree, td.SOURCE_ROOT),
                               health=health.health_scores(metrics, health.tree_file_counts(tree)))
    return rows.select("repo", "snapshot_id", "timestamp", "label", "lines", "complexity", "unused",
                       "duplication", "cycles", "node_count", "root_id", "overall", "trend")


# ---- report round trips: analyzer-format JSON derived from the tables, read back ----------
# One small document per file / issue / clone / edge, so no document grows with a hot key.


def _as_reports(df, doc):
    return df.select("repo", "snapshot_id", F.to_json(doc).alias("raw"))


@query("s6_report_file_stats")
def q_s6(spark, d):
    st = _stats(spark, d)
    doc = F.array(F.struct(F.col("language").alias("Name"), F.array(F.struct(
        F.col("path").alias("Location"), F.col("lines").alias("Lines"), F.col("code").alias("Code"),
        F.col("complexity").alias("Complexity"))).alias("Files")))
    return rp.scc_files(_as_reports(st, doc)).select("repo", "snapshot_id", "path", "language", "lines",
                                                     "code", "complexity")


def _unused_reports(spark, d):
    """One analyzer report for each issue."""
    iss = _issues(spark, d)

    # '{"file":f}' and '{"kind":[n]}' -> '{"file":f,"kind":[n]}'
    issue_doc = F.concat(F.lit('{"issues":['), F.rtrim(F.to_json(F.struct(F.col("file"))), F.lit("}")), F.lit(","),
                         F.substr(F.to_json(F.create_map(F.col("kind"), F.array(F.struct(F.col("name"))))), F.lit(2)), F.lit("]}"))
    raw = (F.when(F.col("kind") == "files", F.to_json(F.struct(F.array(F.col("file")).alias("files"))))
           .otherwise(issue_doc))
    return iss.select("repo", "snapshot_id", raw.alias("raw"))


@query("f17_report_items")
def q_f17(spark, d):
    return rp.unused_report_items(_unused_reports(spark, d))


@query("s7_unused_report_metrics")
def q_s7(spark, d):
    return rp.unused_report_metrics(_unused_reports(spark, d)).select("repo", "snapshot_id", "unused_files", "unused_exports", "unused_types",
                                                                      "unused_dependencies", "total_issues")


@query("s8_clone_report_counts")
def q_s8(spark, d):
    c = _clones(spark, d)
    side = lambda p, a, b: F.struct(F.col(p).alias("name"), F.struct(F.col(a).alias("line")).alias("startLoc"),
                                    F.struct(F.col(b).alias("line")).alias("endLoc"))
    doc = F.struct(F.array(F.struct(side("first_file", "first_start", "first_end").alias("firstFile"),
                                    side("second_file", "second_start", "second_end").alias("secondFile"),
                                    F.col("lines"))).alias("duplicates"))
    return rp.clone_report_counts_by_file(_as_reports(c, doc))


@query("s9_graph_report_cycle_counts")
def q_s9(spark, d):
    e = _circular_paths(spark, d)
    doc = F.struct(F.array(F.struct(F.col("src_path").alias("source"), F.array(F.struct(
        F.col("dst_path").alias("resolved"), F.lit(True).alias("circular"))).alias("dependencies"))).alias("modules"))
    return rp.graph_cycle_counts_by_file(_as_reports(e, doc)).select("repo", "snapshot_id", "path", "cycles")


# ---- snapshot store round trip: daily snapshots saved as bundles in the shared folder, read back ----------
KEEP_SNAPSHOTS = 10


def _stored_history(spark, d):
    """The folder of a new history: one bundle a day with the first check of each metric kind."""
    kind, n = F.col("kind"), F.col("count_value")
    metrics = F.struct(
        kind, F.when(kind == "stats-overview", n).alias("totalLines"),
        F.when(kind == "stats-overview", F.floor("percent_value")).alias("totalComplexity"),
        F.when(kind == "unused", n).alias("totalIssues"),
        F.when(kind == "duplicates", F.col("percent_value")).alias("duplicatedLinesPercent"),
        F.when(kind == "cycles", n).alias("cycleCount"))
    check = F.struct("check_idx", "name", F.lit("pass").alias("status"), metrics.alias("metrics"))
    daily = hist.first_metrics(_checks(spark, d)).groupBy("repo", "snapshot_id").agg(
        F.array_sort(F.collect_list(check)).alias("checks"), F.sum(n).alias("counted"))  # one check a kind
    artifact = F.struct(F.lit("unused").alias("id"), F.lit("unused").alias("checkName"), F.lit("json").alias("format"),
                        F.lit("artifacts/unused.json").alias("path"))
    bundles = daily.select(
        "repo", "snapshot_id", F.lit(store.SNAPSHOT_VERSION).alias("version"), F.col("snapshot_id").alias("id"),
        F.transform("checks", lambda c: F.struct(c["name"], c["status"], c["metrics"])).alias("checks"),
        F.array(artifact).alias("artifacts"), F.concat(F.lit("# "), "snapshot_id").alias("report_text"),
        F.lit('{"rootId":"src"}').alias("tree_json"),
        F.create_map(F.lit("unused"), F.to_json(F.struct(F.col("counted")))).alias("artifact_json"))
    base = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    store.save_bundles(bundles, base)
    return base


@query("s1_stored_trend")
def q_s1(spark, d):
    return store.trend_from_summaries(store.load_summaries(spark, _stored_history(spark, d)))


@query("s2_latest_snapshot")
def q_s2(spark, d):
    return store.load_latest(spark, _stored_history(spark, d)).select("repo", "snapshot_id", F.size("checks").cast("bigint").alias("checks"))


@query("s3_bundles")
def q_s3(spark, d):
    b = store.load_bundles(spark, _stored_history(spark, d))
    return b.select("repo", "snapshot_id", "report_text",
                    F.variant_get(F.parse_json("tree_json"), "$.rootId", "string").alias("root_id"),
                    F.variant_get(F.parse_json(F.col("artifact_json")["unused"]), "$.counted", "bigint").alias("counted"))


@query("s5_retained_snapshots")
def q_s5(spark, d):
    kept, removed = store.prune_plan(store.load_summaries(spark, _stored_history(spark, d)), KEEP_SNAPSHOTS)
    return kept.select("repo", "snapshot_id", F.lit(True).alias("kept")).unionByName(
        removed.select("repo", "snapshot_id", F.lit(False).alias("kept")))


# ---- annotated sources: blank and comment lines, copies in different folders -------------------
def _annotated_clones(spark, d, **kw):
    return cl.clone_pairs(td.annotated_files(spark, d), CloneParams(**kw))


@query("c1_annotated_line_stats")
def q_c1_annotated(spark, d):
    return corpus.line_stats(td.annotated_files(spark, d)).select(
        "repo", "snapshot_id", "path", "language", "lines", "blanks", "comments", "code")


@query("c7_annotated_cross_folder")
def q_c7_annotated(spark, d):
    return _annotated_clones(spark, d, mode="weak", skip_local=True)


@query("c8_annotated_strict")
def q_c8_annotated_strict(spark, d):
    return _annotated_clones(spark, d, mode="strict")


@query("c8_annotated_mild")
def q_c8_annotated_mild(spark, d):
    return _annotated_clones(spark, d)


@query("c8_annotated_weak")
def q_c8_annotated_weak(spark, d):
    return _annotated_clones(spark, d, mode="weak")
