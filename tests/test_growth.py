"""What keeps the figures of large inputs in proportion: nothing stays in executor memory, inputs are read once."""

import datetime
import time

from pyspark.sql import functions as F

from codehealth.functions import paths
from codehealth.operators import clones as cl
from codehealth.operators import depgraph as g
from codehealth.operators import unused as un
from codehealth.session import saved
from codehealth.sources import reports as rp
from codehealth.sources import testdata as td


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_loops_leave_nothing_in_memory(spark):
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 5), (5, 6), (7, 7)], "src bigint, dst bigint")
    assert {tuple(r) for r in g.circular_edges(edges).collect()} == {(1, 2), (2, 3), (3, 1), (5, 6), (6, 5), (7, 7)}
    assert {r.node for r in g.reachable(edges, edges.filter("src = 4").select(F.col("src").alias("node"))).collect()} == {4, 5, 6}
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def test_report_items_read_a_report_once(spark, tmp_dir):
    doc = '{"files":["a.ts",{"path":"b.ts"}],"issues":[{"file":"c.ts","exports":[{"name":"x","line":3},"y"]},{"types":["z"]},null]}'
    spark.createDataFrame([("r", "s", doc), ("r", "s", "{"), ("r", "s", None)], "repo string, snapshot_id string, raw string").write.parquet(f"{tmp_dir}/in")
    items = rp.unused_report_items(spark.read.parquet(f"{tmp_dir}/in"))
    assert _plan(items).count("FileScan parquet") == 1
    assert sorted((r.file or "", r.kind, r.name or "", r.line or 0) for r in items.collect()) == [
        ("", "types", "z", 0), ("a.ts", "files", "", 0), ("b.ts", "files", "", 0), ("c.ts", "exports", "x", 3), ("c.ts", "exports", "y", 0)]


def test_workspaces_read_used_packages_once(spark, tmp_dir):
    snap = "repo string, snapshot_id string"
    rows = [("r", "s", f, "p") for f in ("a/x.ts", "a/x.test.ts", "a/test/y.ts", "b/__tests__x.ts", None)] * 2
    spark.createDataFrame(rows, f"{snap}, file string, package string").write.parquet(f"{tmp_dir}/used")
    used = spark.read.parquet(f"{tmp_dir}/used")
    declared = spark.createDataFrame([("r", "s", ".", "q", "dependencies")], f"{snap}, manifest string, package string, kind string")
    out = un.workspace_issues(used, declared, spark.createDataFrame([("r", "s", ".")], f"{snap}, folder string"), strict=True)
    assert not set(out.inputFiles()) & set(used.inputFiles())
    assert sorted((r.file, r.kind, r["name"]) for r in out.collect()) == [
        ("a/x.ts", "unlisted", "p"), ("b/__tests__x.ts", "unlisted", "p"), ("package.json", "dependencies", "q")]


def test_globs_look_for_their_plain_text_first(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.test.ts", "test/a", "a/test", "a/testing", "x.ts", None)], "path string")
    kept = paths.exclude_globs(df, "path", un.NON_PRODUCTION_GLOBS)
    assert "Contains" in kept._jdf.queryExecution().analyzed().toString()
    assert sorted(r.path for r in kept.collect()) == ["a/testing", "x.ts"]


def test_monthly_tables_share_one_join(spark, tmp_dir):
    spark.createDataFrame([(1, 1, 7, 1, "R", 5.0), (1, 2, 8, 1, "N", 5.0), (2, 1, 7, 1, "N", 5.0)],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{tmp_dir}/lineitem.parquet")
    day = datetime.datetime(1995, 12, 31, 23)
    spark.createDataFrame([(1, day), (2, None)], "o_orderkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_dir}/orders.parquet")
    spark.createDataFrame([(7, "B", 3), (8, "C", 9)], "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_dir}/part.parquet")
    modules, edges = td.modules(spark, tmp_dir), td.dep_edges(spark, tmp_dir)
    assert not any("lineitem" in f for f in modules.inputFiles() + edges.inputFiles())
    month = (1995 * 12 + 12) * td.NODE_STEP
    assert [tuple(r) for r in edges.collect()] == [(month + 7, month + 8)]
    assert sorted((r.snapshot_id or "", r.node or 0, r.path, r.size) for r in modules.collect()) == [
        ("", 0, "src/B/7", 3), ("1995-12", month + 7, "src/B/7", 3), ("1995-12", month + 8, "src/C/8", 9)]


def test_clones_normalise_lines_twice_at_most(spark, tmp_dir, monkeypatch):
    text = "\n".join(f"let name{i} = call(other{i}, third{i}, fourth{i}, fifth{i});" for i in range(8))
    rows = [("r", "s", f"{f}.ts", "ts", t) for f, t in (("a", text), ("b", "x;\n" + text), ("c", "y;\n" + text + "\nz;"), ("d", None))]
    spark.createDataFrame(rows, "repo string, snapshot_id string, path string, language string, content string").write.parquet(f"{tmp_dir}/in")
    passes, kept = [], cl.saved
    monkeypatch.setattr(cl, "saved", lambda df: (passes.append(_plan(df).count(f"{tmp_dir}/in")), kept(df))[1])
    runs = cl.clone_pairs(spark.read.parquet(f"{tmp_dir}/in"))
    assert sum(passes) <= 2 and not any(tmp_dir in f for f in runs.inputFiles())
    assert sorted((r.first_file, r.first_start, r.second_file, r.second_start, r.norm_lines) for r in runs.collect()) == [
        ("a.ts", 1, "b.ts", 2, 8), ("a.ts", 1, "c.ts", 2, 8)]


def test_entries_drop_large_parts_before_they_are_made_distinct(spark, tmp_dir):
    day = datetime.datetime(1995, 12, 31)
    spark.createDataFrame([(1, 1, 7, 1, "R", 5.0), (1, 2, 8, 1, "N", 5.0), (1, 3, 7, 2, "N", 5.0), (1, 4, None, 2, "N", 5.0)],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{tmp_dir}/lineitem.parquet")
    spark.createDataFrame([(1, day)], "o_orderkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_dir}/orders.parquet")
    parts = [(7, "B", 3), (7, "B", 4), (8, "C", 9), (9, "C", 1), (None, "C", 1)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_dir}/part.parquet")
    nodes = td.entries(spark, tmp_dir)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # printed from the top
    assert [r.node for r in nodes.collect()] == [(1995 * 12 + 12) * td.NODE_STEP + 7] * 2


def _odd_reports(spark, tmp_dir):
    docs = ['{"files":["a",{"path":"b"},{"x":[{"name":"q"}]},5,null],"issues":[{"file":"c","exports":[{"name":"x","line":3},"y"],"types":{"a":["z",{"col":2}]}},null]}',
            '{"issues":[{"file":5,"exports":[{"name":1.50},{"name":12345678901234567890},{"name":7,"line":2.0}]},{"file":{"b":1},"exports":["x"]}]}',
            '{"issues":[{"file":"t","exports":["x"]}]} {"b":2}', "1,2", "[1", "2]", "{", "", None,
            '{"issues":[{"file":"dup","exports":["x"],"exports":["y","z"]}]}', '{"files":["u\\ud83d\\ude00"],"issues":[{"\\u0066ile":"e","catalog":["q"]}]}',
            '{"issues":[{"file":"","exports":"lone","types":{"name":""},"other":["no"],"files":["f"]}]}']
    rows = [("r", f"s{i}", d) for i, d in enumerate(docs)] + [(None, "s", '{"files":["x"]}'), ("r", "s0", '{"files":[1]}')]
    spark.createDataFrame(rows, "repo string, snapshot_id string, raw string").repartition(1).write.parquet(f"{tmp_dir}/in")
    return spark.read.parquet(f"{tmp_dir}/in")


def test_report_metrics_are_summed_where_reports_are_read(spark, tmp_dir):
    out = rp.unused_report_metrics(_odd_reports(spark, tmp_dir))
    plan = _plan(out)
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    # a snapshot with a null issue (s0), a null or a malformed report has no row; of repeated keys the last counts
    assert sorted((r.repo or "", r.snapshot_id, r.unused_files, r.unused_exports, r.unused_dependencies, r.total_issues) for r in out.collect()) == [
        ("", "s", 1, 0, 0, 1), ("r", "s1", 0, 4, 0, 4), ("r", "s10", 1, 0, 1, 2), ("r", "s11", 0, 0, 0, 0), ("r", "s9", 0, 2, 0, 2)]


def test_plain_reports_go_to_the_arrow_function_whole(spark, tmp_dir):
    out = rp.unused_report_items(_odd_reports(spark, tmp_dir))
    assert "RLIKE" in _plan(out)
    # repeated keys make a report malformed here; text after a report is ignored
    assert sorted((r.repo or "", r.snapshot_id, r.file or "", r.kind, r.name or "", r.line or 0) for r in out.collect()) == sorted([
        ("", "s", "x", "files", "", 0), ("r", "s0", "a", "files", "", 0), ("r", "s0", "b", "files", "", 0), ("r", "s0", "q", "files", "", 0),
        ("r", "s0", "c", "exports", "x", 3), ("r", "s0", "c", "exports", "y", 0), ("r", "s0", "c", "types", "z", 0), ("r", "s0", "c", "types", "", 0),
        ("r", "s1", "5", "exports", "1.5", 0), ("r", "s1", "5", "exports", "12345678901234567890", 0), ("r", "s1", "5", "exports", "7", 2),
        ("r", "s1", '{"b":1}', "exports", "x", 0), ("r", "s2", "t", "exports", "x", 0), ("r", "s10", "u\U0001f600", "files", "", 0),
        ("r", "s10", "e", "catalog", "q", 0), ("r", "s11", "", "exports", "lone", 0), ("r", "s11", "", "types", "", 0)])


def test_report_texts_are_parsed_many_at_a_time(monkeypatch):
    calls, loads = [], rp.json.loads
    monkeypatch.setattr(rp.json, "loads", lambda t: (calls.append(t), loads(t))[1])
    assert list(rp._values(['{"a":1}', " [2] ", None] * 300)) == [{"a": 1}, [2], None] * 300
    assert len(calls) == 1
    # texts that are no documents of their own, but would be together
    assert list(rp._values(["1,2", "[3", "4]", '"a', 'b"', "", "5"])) == [None] * 6 + [5]
    assert list(rp._values(["1 x", "{", "2"], first=True)) == [1, None, 2]


def test_shuffle_files_go_with_the_query_that_wrote_them(spark, tmp_dir):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folder.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = held()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    rows = sorted(map(tuple, df.collect()))
    saved(df)
    end = time.time() + 20
    while held() - before and time.time() < end:  # files are removed in the background
        time.sleep(0.1)
    assert not held() - before
    assert sorted(map(tuple, df.collect())) == rows and df.persist().count() == 7
    df.unpersist()


def test_package_differences_deal_out_each_side_once(spark, tmp_dir):
    day = datetime.datetime(1995, 12, 31)
    spark.createDataFrame([(1, 1, 7, 1, "R", 5.0, day), (1, 2, 8, 1, "N", 5.0, day), (1, 3, 8, 1, "N", 5.0, day), (1, 4, None, 2, "N", 5.0, None), (2, 1, 8, None, "N", 1.0, day)],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_dir}/lineitem.parquet")
    spark.createDataFrame([(1, day), (2, None)], "o_orderkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_dir}/orders.parquet")
    spark.createDataFrame([(7, "B", 30), (7, "B", 45), (8, "C", 9), (9, "C", 50)], "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_dir}/part.parquet")
    used, declared = td.used_packages(spark, tmp_dir), td.declared_packages(spark, tmp_dir)
    key = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        # declared packages are read from the shared table; modules deal out line items and parts twice by part
        unlisted, unused = un.unlisted_dependencies(used, declared), un.unused_dependencies(declared, used)
        assert [_plan(x).count("Exchange ") for x in (unlisted, unused, td.modules(spark, tmp_dir))] == [2, 2, 3]
    finally:
        spark.conf.set(key, kept)
    assert sorted((r.snapshot_id or "", r.package or "", r.file or "") for r in used.collect()) == [
        ("", "pkg-8", ""), ("1995-12", "", "src/supp/2"), ("1995-12", "pkg-7", "src/supp/1"), ("1995-12", "pkg-8", "src/supp/1")]
    assert sorted((r.snapshot_id, r.package, r.kind) for r in declared.collect()) == [
        ("1995-12", "pkg-7", "dependencies"), ("1995-12", "pkg-7", "devDependencies")]
    assert sorted((r.snapshot_id or "", r.package or "", r.file or "") for r in unlisted.collect()) == [
        ("", "pkg-8", ""), ("1995-12", "", "src/supp/2"), ("1995-12", "pkg-8", "src/supp/1")]
    assert unused.collect() == []
