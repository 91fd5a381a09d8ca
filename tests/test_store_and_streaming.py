"""Snapshot store (S1-S5, S11), sinks (S12-S14), details (J4) and streaming ingest."""

import json
import os

from pyspark.sql import functions as F

from codehealth.plans import dashboard
from codehealth.sources import store
from codehealth.streaming import snapshots as stream


def _summary(ts, commit, version=3, checks=None, artifacts=()):
    sid = ts.replace(":", "-") + "_" + commit
    return sid, {"version": version, "id": sid, "timestamp": ts, "git": {"commit": commit, "dirty": False},
                 "duration": 10, "checks": checks or [], "artifacts": [
                     {"id": a, "checkName": "x", "format": "json", "path": f"artifacts/{a}.json"} for a in artifacts],
                 "tree": {"path": "src", "rootId": "src", "nodeCount": 1}}


def _write(base, repo, sid, doc, tree=True, artifacts=(), raw=None):
    d = os.path.join(base, repo, "snapshots", sid)
    os.makedirs(os.path.join(d, "artifacts"), exist_ok=True)
    with open(os.path.join(d, "summary.json"), "w") as fh:
        fh.write(raw if raw is not None else json.dumps(doc, indent=2))
    with open(os.path.join(d, "report.md"), "w") as fh:
        fh.write("# report\n")
    if tree:
        with open(os.path.join(d, "tree.json"), "w") as fh:
            fh.write("{}")
    for a in artifacts:
        with open(os.path.join(d, "artifacts", f"{a}.json"), "w") as fh:
            fh.write("[]")


def test_history_order_limit_and_malformed(spark, tmp_dir):
    for ts, c in (("2026-03-10T10:00:00.000Z", "aaa1111"), ("2026-03-10T11:00:00.000Z", "bbb2222")):
        sid, doc = _summary(ts, c)
        _write(tmp_dir, "r", sid, doc)
    _write(tmp_dir, "r", "2026-03-10T12-00-00.000Z_ccc3333", None, raw="{not json")
    all_ = store.load_summaries(spark, tmp_dir).orderBy(F.desc("snapshot_id")).collect()
    assert [r.git.commit for r in all_] == ["bbb2222", "aaa1111"]
    # the newest directory is malformed: limit 1 is applied before the filter
    assert store.load_latest(spark, tmp_dir).count() == 0
    assert store.load_summaries(spark, tmp_dir, limit=1, filter_first=True).first().git.commit == "bbb2222"


def test_version_filter_and_bundles(spark, tmp_dir):
    sid1, d1 = _summary("2026-03-10T10:00:00.000Z", "aaa1111", artifacts=("unused",))
    sid2, d2 = _summary("2026-03-10T11:00:00.000Z", "bbb2222", artifacts=("unused",))
    sid3, d3 = _summary("2026-03-10T12:00:00.000Z", "ccc3333", version=2)
    _write(tmp_dir, "r", sid1, d1, artifacts=("unused",))
    _write(tmp_dir, "r", sid2, d2, artifacts=())  # declared artifact missing -> bundle dropped
    _write(tmp_dir, "r", sid3, d3)
    assert store.load_summaries(spark, tmp_dir).count() == 2
    assert [r.snapshot_id for r in store.load_bundles(spark, tmp_dir).collect()] == [sid1]


def test_prune_keeps_newest(spark, tmp_dir):
    snaps = spark.createDataFrame([("r", f"2026-03-10T1{h}-00-00.000Z_c{h}") for h in range(3)],
                                  "repo string, snapshot_id string")
    kept, removed = store.prune_plan(snaps, 2)
    assert removed.count() == 1
    assert sorted(r.snapshot_id for r in kept.collect()) == ["2026-03-10T11-00-00.000Z_c1",
                                                             "2026-03-10T12-00-00.000Z_c2"]
    assert store.prune_plan(snaps, 0)[1].count() == 0


def test_save_tables_replace_and_prune(spark, tmp_dir):
    base = os.path.join(tmp_dir, "tables")
    df = spark.createDataFrame([("r", "s1", 1), ("r", "s2", 2), ("r", "s3", 3)],
                               "repo string, snapshot_id string, v int")
    store.save_tables({"t": df}, base)
    store.save_tables({"t": spark.createDataFrame([("r", "s2", 20)], "repo string, snapshot_id string, v int")},
                      base)
    got = {r.snapshot_id: r.v for r in spark.read.parquet(f"{base}/t").collect()}
    assert got == {"s1": 1, "s2": 20, "s3": 3}
    assert store.prune_tables(spark, base, ["t"], 2) == 1
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{base}/t").collect()) == ["s2", "s3"]


def test_commit_log(spark, tmp_dir):
    p = os.path.join(tmp_dir, "log.txt")
    with open(p, "w") as fh:
        fh.write("abcdef1\x1fabcdef1\x1f2026-03-10T10:00:00+01:00\x1ffix: a\n")
        fh.write("\x1f\x1f\x1fbroken\n")
    commits, rejected = store.read_commit_log(spark, p)
    assert commits.count() == 1 and rejected.count() == 1
    assert commits.first().subject == "fix: a"


def test_unused_item_labels(spark):
    issues = spark.createDataFrame([("r", "s", "src/a.ts", "exports", "unusedThing", 9),
                                    ("r", "s", "src/a.ts", "exports", "unusedThing", 9),
                                    ("r", "s", "src/b.ts", "files", None, None)],
                                   "repo string, snapshot_id string, file string, kind string, name string, line long")
    got = sorted((r.file, r.label) for r in dashboard.unused_items(issues).collect())
    assert got == [("src/a.ts", "Unused export: unusedThing (line 9)"), ("src/b.ts", "Entire file unused")]


def test_streaming_ingest(spark, tmp_dir):
    checks = [{"name": "stats", "status": "pass", "metrics": {"kind": "stats-overview", "totalLines": 100,
                                                              "totalComplexity": 7}},
              {"name": "unused", "status": "warn", "metrics": {"kind": "unused", "totalIssues": 2}},
              {"name": "dup", "status": "warn", "metrics": {"kind": "duplicates", "duplicatedLinesPercent": 1.5}},
              {"name": "cyc", "status": "fail", "metrics": {"kind": "cycles", "cycleCount": 1}}]
    hist = os.path.join(tmp_dir, "hist")
    sid, doc = _summary("2026-03-10T10:00:00.000Z", "aaa1111", checks=checks)
    _write(hist, "r", sid, doc)
    out = os.path.join(tmp_dir, "out")
    q = stream.start_ingest(spark, hist, out, os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    row = spark.read.parquet(f"{out}/snapshot_rows").first()
    assert (row.repo, row.snapshot_id, row["pass"], row.warn, row.fail) == ("r", sid, 1, 2, 1)
    assert (row.lines, row.complexity, row.unused, row.duplication, row.cycles) == (100, 7, 2, 1.5, 1)


def test_results_json_sink(spark, tmp_dir):
    df = spark.createDataFrame([("r", "s", "stats", "pass", "ok", 5)],
                               "repo string, snapshot_id string, name string, status string, summary string, "
                               "duration_ms long")
    path = os.path.join(tmp_dir, "results")
    dashboard.write_results_json(df, path)
    back = spark.read.json(path).first()
    assert (back.name, back.status, back.duration_ms) == ("stats", "pass", 5)


def test_issue_filters_gates_and_report_tables(spark, tmp_dir):
    from codehealth.operators import unused as un
    from codehealth.operators import clones as cl
    from codehealth.functions import formatting as fmt
    issues = spark.createDataFrame([
        ("r", "s", "src/a.ts", "exports", "x", ["public"]), ("r", "s", "src/a.test.ts", "exports", "y", []),
        ("r", "s", "package.json", "devDependencies", "jest", []), ("r", "s", "src/b.ts", "types", "T", ["internal"])],
        "repo string, snapshot_id string, file string, kind string, name string, tags array<string>")
    prod = {r.name for r in un.filter_issues(issues, production=True).collect()}
    assert prod == {"x", "T"}
    assert {r.name for r in un.filter_issues(issues, tags_exclude=("internal",)).collect()} == {"x", "y", "jest"}
    m = un.unused_metrics(issues)
    assert un.max_issues_gate(m, 3).first().exceeds_max_issues is True
    totals = spark.createDataFrame([("r", "s", 2.5)], "repo string, snapshot_id string, duplicated_lines_percent double")
    assert cl.threshold_gate(totals, 2.0).first().exceeds_threshold is True
    assert spark.range(1).select(fmt.strip_ansi(F.lit("\x1b[31mred\x1b[0m")).alias("s")).first().s == "red"
    status = spark.createDataFrame([("r", "s", 1, 0, 0, 0)], "repo string, snapshot_id string, pass long, "
                                                             "warn long, fail long, skip long")
    tables = dashboard.report_tables(status)
    dashboard.write_tables(tables, os.path.join(tmp_dir, "report"))
    assert spark.read.parquet(os.path.join(tmp_dir, "report", "status_counts")).count() == 1


def test_latest_per_repository(spark, tmp_dir):
    for repo, hours in (("alpha", (10, 11, 12)), ("beta", (9,))):
        for h in hours:
            sid, doc = _summary(f"2026-03-10T{h:02d}:00:00.000Z", f"{repo[0]}{h}")
            _write(tmp_dir, repo, sid, doc)
    latest = {r.repo: r.git.commit for r in store.load_latest(spark, tmp_dir).collect()}
    assert latest == {"alpha": "a12", "beta": "b9"}
    two = store.load_summaries(spark, tmp_dir, limit=2)
    assert sorted((r.repo, r.git.commit) for r in two.collect()) == [("alpha", "a11"), ("alpha", "a12"),
                                                                      ("beta", "b9")]


def test_bundles_need_every_part(spark, tmp_dir):
    ids = []
    for h in range(5):
        sid, doc = _summary(f"2026-03-10T1{h}:00:00.000Z", f"c{h}", artifacts=("unused",))
        _write(tmp_dir, "r", sid, doc, artifacts=("unused",))
        ids.append(os.path.join(tmp_dir, "r", "snapshots", sid))
    os.remove(os.path.join(ids[0], "report.md"))
    for path in (os.path.join(ids[1], "tree.json"), os.path.join(ids[2], "artifacts", "unused.json")):
        with open(path, "w") as fh:
            fh.write("{not json")
    with open(os.path.join(ids[3], "report.md"), "w") as fh:
        fh.write("")  # an empty report is a report
    got = {r.snapshot_id: (r.report_text, r.tree_json, r.artifact_json) for r in store.load_bundles(spark, tmp_dir).collect()}
    assert got == {os.path.basename(ids[3]): ("", "{}", {"unused": "[]"}),
                   os.path.basename(ids[4]): ("# report\n", "{}", {"unused": "[]"})}


def test_bundle_round_trip(spark, tmp_dir):
    base, copy = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    for h in range(3):
        sid, doc = _summary(f"2026-03-10T1{h}:00:00.000Z", f"c{h}", artifacts=("unused", "cycles"),
                            checks=[{"name": "stats", "status": "pass", "metrics": {"kind": "unused", "totalIssues": h}}])
        _write(base, "r", sid, doc, artifacts=("unused", "cycles"))
    bundles = store.load_bundles(spark, base)
    assert store.save_bundles(bundles, copy) == 15
    assert store.save_bundles(bundles, copy) == 15  # saved again: replaced
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.load_bundles(spark, copy)) == rows(bundles)
    assert rows(store.load_summaries(spark, copy)) == rows(store.load_summaries(spark, base))
    assert [r.snapshot_id for r in store.load_latest(spark, copy).collect()] == ["2026-03-10T12-00-00.000Z_c2"]


def test_dashboard_from_stored_bundles(spark, tmp_dir):
    def node(path, kind, lines, issues, **more):
        return {"path": path, "name": path.split("/")[-1], "kind": kind, "childIds": [],
                "stats": {"files": 1, "lines": lines, "code": lines, "complexity": lines // 10},
                "issues": {"total": issues, "unused": issues, "duplication": 0, "cycles": 0}, **more}
    nodes = [node("src", "dir", 500, 3), node("src/lib", "dir", 400, 2),
             node("src/lib/a.ts", "file", 400, 2, dependency={"dependencies": 1, "dependents": 3, "instability": 0.25,
                                                              "inCycle": False}),
             node("src/b.ts", "file", 100, 1)]
    checks = [{"name": "stats", "status": "pass", "metrics": {"kind": "stats-overview", "totalFiles": 2, "totalLines": 500,
                                                              "totalCode": 500, "totalComplexity": 50}},
              {"name": "unused", "status": "warn", "metrics": {"kind": "unused", "totalIssues": 3}},
              {"name": "dup", "status": "warn", "metrics": {"kind": "duplicates", "duplicatedLinesPercent": 4.0}},
              {"name": "cyc", "status": "pass", "metrics": {"kind": "cycles", "cycleCount": 0}},
              {"name": "more", "status": "skip", "metrics": {"kind": "other"}}]
    sid, doc = _summary("2026-03-10T10:00:00.000Z", "aaa1111", checks=checks, artifacts=("unused", "duplicates"))
    summary = spark.createDataFrame([("r", sid, json.dumps(doc))], "repo string, snapshot_id string, j string")
    parts = {"unused": {"files": ["src/b.ts"], "issues": [{"file": "src/lib/a.ts", "exports": [{"name": "x", "line": 2}]}]},
             "duplicates": {"duplicates": [{"firstFile": {"name": "src/b.ts", "start": 1, "end": 9},
                                            "secondFile": {"name": "src/lib/a.ts", "start": 5, "end": 13}, "lines": 9}]}}
    tree = {"rootId": "src", "nodes": {n["path"]: n for n in nodes}}
    bundle = (summary.select("repo", "snapshot_id", F.from_json("j", store.SUMMARY).alias("s")).select("repo", "snapshot_id", "s.*")
              .withColumns({"report_text": F.lit("# report"), "tree_json": F.lit(json.dumps(tree)),
                            "artifact_json": F.create_map(*[F.lit(x) for k, v in parts.items() for x in (k, json.dumps(v))])}))
    base, out = os.path.join(tmp_dir, "hist"), os.path.join(tmp_dir, "out")
    store.save_bundles(bundle, base)
    dashboard.write_dashboard(spark, base, out)
    read = lambda name: spark.read.parquet(f"{out}/{name}").collect()
    row = read("rows")[0]
    assert (row["pass"], row.warn, row.skip, row.lines, row.unused, row.duplication) == (2, 2, 1, 500, 3, 4.0)
    # 100-4*5, 100-3/2*50, 100-50/500*100*2.5, one file of two above 350 lines, one above complexity 10
    assert (row.overall, row.trend, row.commit, row.root_id) == (56, 0, "aaa1111", "src")
    assert {r.path: (r.score, r.instability_signal) for r in read("file_hotspots")} == \
        {"src/lib/a.ts": (100, 0.25), "src/b.ts": (35, 0.0)}
    assert [(r.path, r.score, r.instability_signal) for r in read("dir_hotspots")] == [("src/lib", 100, 0.0)]
    assert [r.path for r in sorted(read("largest_files"), key=lambda r: r.position)] == ["src/lib/a.ts", "src/b.ts"]
    assert len(read("complex_files")) == 2 and len(read("tree")) == 4
    assert sorted((r.file, r.label) for r in read("unused_items")) == \
        [("src/b.ts", "Entire file unused"), ("src/lib/a.ts", "Unused export: x (line 2)")]
    assert sorted((r.path, r.self_range, r.other_range) for r in read("clone_details")) == \
        [("src/b.ts", "lines 1–9", "lines 5–13"), ("src/lib/a.ts", "lines 5–13", "lines 1–9")]


def test_short_histories_are_named(spark):
    from codehealth.operators import history
    commits = spark.createDataFrame([("long", i) for i in range(5)] + [("short", 0)], "repo string, sha int")
    assert [tuple(r) for r in history.short_histories(commits, 2, 2).collect()] == [("short", 1, 5)]


def _trend_file(spark, folder, rows):
    spark.createDataFrame(rows, _TREND).coalesce(1).write.mode("append").parquet(folder)


_TREND = ("repo string, snapshot_id string, ts timestamp, lines bigint, complexity bigint, unused bigint, "
          "duplication double, cycles bigint")


def test_streamed_deltas_equal_batch_deltas_in_any_order(spark, tmp_dir):
    import random
    from datetime import datetime, timedelta

    from codehealth.operators import history

    r = random.Random(5)
    rows = []
    for repo in ("a", "b", None):
        for i in range(9):
            ts = datetime(2026, 1, 1) + timedelta(days=i // 2)  # ties are ordered by id
            values = [r.randrange(1000), r.randrange(50), r.randrange(9), r.randrange(90) / 8, r.randrange(5)]
            if i == 4:
                values = [None] * 5
            rows.append((repo, f"s{i}", ts, *values))
    old = [("a", "s3", datetime(2026, 1, 9), 1, 1, 1, 1.0, 1)]  # saved again later, at another time
    order = r.sample(rows, len(rows))
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("src", "out", "ckpt"))
    # the stream is stopped and started again between the batches: the state carries over
    for part in (old, order[:5], order[5:6], order[6:20], order[20:]):
        _trend_file(spark, src, part)
        arriving = spark.readStream.schema(_TREND).option("maxFilesPerTrigger", 1).parquet(src)
        stream.start_deltas(arriving, out, ckpt).awaitTermination(120)
    got = stream.current_rows(spark, out)
    df = spark.createDataFrame([x for x in rows if x[0]], _TREND)
    want = history.metric_deltas(df.drop("ts"), df.select("repo", "snapshot_id", "ts"))
    plain = lambda d: sorted((tuple(x) for x in d.select(want.columns).collect()), key=repr)
    assert plain(got.filter("repo IS NOT NULL")) == plain(want)
    assert got.filter("repo IS NULL").count() == 9


def test_trend_rows_of_a_stream_of_summaries(spark, tmp_dir):
    checks = [{"name": "stats", "status": "pass", "metrics": {"kind": "stats-overview", "totalLines": 100, "totalComplexity": 7}},
              {"name": "again", "status": "pass", "metrics": {"kind": "stats-overview", "totalLines": 1, "totalComplexity": 1}},
              {"name": "none", "status": "skip"},
              {"name": "unused", "status": "warn", "metrics": {"kind": "unused", "totalIssues": 2}},
              {"name": "dup", "status": "warn", "metrics": {"kind": "duplicates", "duplicatedLinesPercent": 1.5}},
              {"name": "cyc", "status": "fail", "metrics": {"kind": "cycles", "cycleCount": 1}}]
    hist, out = os.path.join(tmp_dir, "hist"), os.path.join(tmp_dir, "out")
    for ts, kept in (("2026-03-10T10:00:00.000Z", checks), ("2026-03-11T10:00:00.000Z", checks[:3]), ("2026-03-12T10:00:00.000Z", [])):
        sid, doc = _summary(ts, "aaa1111", checks=kept)
        _write(hist, "r", sid, doc)
    rows = stream.trend_rows(stream.summary_stream(spark, hist))
    stream.start_deltas(rows, out, os.path.join(tmp_dir, "ckpt")).awaitTermination(120)
    got = [(r.lines, r.complexity, r.unused, r.duplication, r.cycles, r.lines_delta)
           for r in stream.current_rows(spark, out).orderBy("snapshot_id").collect()]
    assert got == [(100, 7, 2, 1.5, 1, None), (None,) * 6, (None,) * 6]
    stored = store.trend_from_summaries(store.load_summaries(spark, hist)).orderBy("snapshot_id").first()
    assert (stored.lines, stored.cycles) == (100, 1)
