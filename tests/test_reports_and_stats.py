"""Fixture tests for the report readers and stats rankings (exact semantics)."""

import json
import random

from pyspark.sql import functions as F

from codehealth.functions.paths import glob_to_regex
from codehealth.operators import corpus
from codehealth.sources import reports as rp


def _reports(spark, doc):
    return spark.createDataFrame([("r", "s1", json.dumps(doc))], "repo string, snapshot_id string, raw string")


def test_scc_overview_totals_and_language_order(spark):
    doc = [
        {"Name": "JavaScript", "Count": 2, "Lines": 50, "Code": 30, "Blank": 10, "Comment": 10, "Complexity": 5},
        {"Name": "TypeScript", "Count": 3, "Lines": 150, "Code": 120, "Blank": 20, "Comment": 10, "Complexity": 15},
    ]
    totals, langs = rp.scc_overview(_reports(spark, doc))
    t = totals.first()
    assert (t.total_files, t.total_lines, t.total_code, t.total_complexity, t.total_blanks, t.total_comments) == \
        (5, 200, 150, 20, 30, 20)
    assert [r.language for r in langs.orderBy("position").collect()] == ["TypeScript", "JavaScript"]


def test_scc_non_array_report_has_no_rows(spark):
    totals, _ = rp.scc_overview(_reports(spark, {"not": "an array"}))
    assert totals.count() == 0


def _stats_df(spark, rows):
    return spark.createDataFrame([("r", "s", p, l, c, x) for p, l, c, x in rows],
                                 "repo string, snapshot_id string, path string, lines long, code long, "
                                 "complexity long")


def test_top_complexity(spark):
    df = _stats_df(spark, [("b", 100, 80, 12), ("a", 90, 70, 20), ("c", 110, 90, 20)])
    got = corpus.top_files(df, "complexity", 2).orderBy("position").collect()
    assert [r.path for r in got] == ["c", "a"]


def test_top_lines(spark):
    df = _stats_df(spark, [("a", 120, 70, 5), ("b", 200, 80, 1), ("c", 200, 90, 10)])
    got = corpus.top_files(df, "lines", 2).orderBy("position").collect()
    assert [r.path for r in got] == ["c", "b"]


def test_unused_report_metrics(spark):
    doc = {"files": ["src/unused.ts"], "issues": [{
        "file": "src/a.ts", "dependencies": [{"name": "x"}], "exports": [{"name": "e"}],
        "nsExports": [{"name": "n"}], "classMembers": [{"name": "c"}], "types": [{"name": "t"}],
        "nsTypes": [{"name": "nt"}], "enumMembers": {"Status": [{"name": "A"}]},
        "unresolved": [{"name": "u"}], "duplicates": [[{"name": "d1"}, {"name": "d2"}]]}]}
    m = rp.unused_report_metrics(_reports(spark, doc)).first()
    assert (m.unused_files, m.unused_exports, m.unused_types, m.unused_dependencies, m.total_issues) == \
        (1, 4, 2, 2, 10)


def test_nested_count_shapes(spark):
    df = spark.createDataFrame([('[1,2,3]',), ('{"a":[1,2],"b":{"c":[1]}}',), ('5',), ('null',)], "raw string")
    got = [r.n for r in df.select(rp.nested_count(F.parse_json("raw")).alias("n")).collect()]
    assert got == [3, 3, 0, 0]


def test_clone_report_totals_current_and_legacy(spark):
    cur = {"statistics": {"total": {"clones": 4, "percentage": 2.5, "percentageTokens": 3.1, "lines": 800}}}
    old = {"statistic": {"total": {"clones": 1, "percentage": 1.0, "percentageTokens": 2.0, "lines": 10}}}
    a = rp.clone_report_totals(_reports(spark, cur)).first()
    assert (a.total_clones, a.duplicated_lines_percent, a.duplicated_tokens_percent, a.total_lines) == \
        (4, 2.5, 3.1, 800)
    b = rp.clone_report_totals(_reports(spark, old)).first()
    assert b.total_clones == 1


def test_graph_cycle_metrics_violations_win(spark):
    doc = {"modules": [{"source": "a", "dependencies": [{"resolved": "b", "circular": True},
                                                        {"resolved": "c", "circular": True}]}],
           "summary": {"totalCruised": 10, "totalDependenciesCruised": 24,
                       "violations": [{"name": "x"}, {"name": "y"}]}}
    m = rp.graph_cycle_metrics(_reports(spark, doc)).first()
    assert (m.total_modules, m.total_dependencies, m.cycle_count) == (10, 24, 2)
    doc["summary"]["violations"] = []
    assert rp.graph_cycle_metrics(_reports(spark, doc)).first().cycle_count == 2


def test_graph_instability_and_rankings(spark):
    from codehealth.operators import depgraph as g
    doc = {"modules": [
        {"source": "app", "dependencies": [{"resolved": "lib", "circular": True}, {"resolved": "ui"}],
         "dependents": [], "instability": 1},
        {"source": "lib", "dependencies": [], "dependents": ["app", "ui"], "instability": 0},
        {"source": "ui", "dependencies": [{"resolved": "lib", "circular": True}], "dependents": ["app"],
         "instability": 0.5}], "summary": {}}
    files = rp.graph_instability(_reports(spark, doc))
    s = g.instability_summary(files).first()
    assert (s.total_files, s.files_in_cycles, s.average_instability, s.highest_dependencies,
            s.highest_dependents) == (3, 2, 0.5, 2, 2)
    assert [r.path for r in g.highly_unstable(files, 2).collect()] == ["app", "ui"]
    assert [r.path for r in g.stable_depended_on(files, 2).collect()] == ["lib", "ui"]


def test_glob_to_regex():
    assert glob_to_regex("**/generated/") == "(^|.*/)generated(/.*)?$"
    assert glob_to_regex("**/*.test.*") == r"(^|.*/)[^/]*\.test\.[^/]*$"
    assert glob_to_regex("src/*.ts") == r"^src/[^/]*\.ts$"


def test_line_stats_blank_comment_complexity(spark):
    text = "// header\n\nif (a && b) {\n  x == 1\n}\n# note\nfor x in y:"
    df = spark.createDataFrame([("r", "s", "src/a.ts", "ts", text)],
                               "repo string, snapshot_id string, path string, language string, content string")
    r = corpus.line_stats(df).first()
    assert (r.lines, r.blanks, r.comments, r.code) == (7, 1, 1, 5)  # '#' opens no comment in this language
    assert r.complexity == 4  # if, for, &&, ==


def test_comments_by_language(spark):
    texts = [("ts", "#x = 1;\n--i;\n/* one\n two\n\n */\nlet a = 1; /* b */\n// c", (8, 0, 5, 3)),
             ("ts", 'let s = "/* no";\nrun(); /* opens\n\n "in */ done();\n/* a */ // b\nx = `\n// in\n\n`', (9, 0, 2, 7)),
             ("rs", "fn f<'a>() // it's\n/* 'x */\n'\\'// no'\n`\n// `", (5, 0, 2, 3)),
             ("py", 'x = """\n# in\n\n""" # out\n"a\n# b"', (6, 0, 1, 5)),
             ("sql", "select 'it''s -- no\n-- in', 1 -- out\n/* '\n*/ select 2\n--'", (5, 0, 2, 3)),
             ("py", "# note\n// 2\n\nx = 1", (4, 1, 1, 2)),
             ("sql", "-- a\nselect 1\n/* open\nstill", (4, 0, 3, 1)),
             ("en", "// a\n# b\n-- c\ntext", (4, 0, 3, 1)),
             ("ts", "", (1, 1, 0, 0)), (None, "// a\nb", (2, 0, 1, 1))]
    df = spark.createDataFrame([("r", "s", str(i), lang, text) for i, (lang, text, _) in enumerate(texts)],
                               "repo string, snapshot_id string, path string, language string, content string")
    got = {int(r.path): (r.lines, r.blanks, r.comments, r.code) for r in corpus.line_stats(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(texts)}


def _classes(text, marker, blocks, long_quotes):
    """Blank, comment and code lines by reading one character after another."""
    code, comment, i, line = set(), set(), 0, 0
    while i < len(text):
        quote = next((q for q in (*long_quotes, '"', "'") if text.startswith(q, i)), None)
        if blocks and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end, seen = (len(text) if end < 0 else end + 2), comment
        elif text.startswith(marker, i):
            end, seen = (text + "\n").index("\n", i), comment
        else:
            seen, end = code, i + 1
            while quote:
                j, escapes = i + len(quote), quote != '"""' and quote != "'''" and marker != "--"
                while j < len(text) and not text.startswith(quote, j) and (quote in long_quotes or text[j] != "\n"):
                    j += 2 if escapes and text[j] == "\\" and text[j + 1:j + 2] != ("" if quote in long_quotes else "\n") \
                        else 1
                if j < len(text) and text.startswith(quote, j):
                    end = j + len(quote)
                elif quote in long_quotes:
                    end = len(text)
                break
            if end == i + 1 and text[i] in " \t\r\n":
                seen = set()
        token = text[i:end]
        seen.update(range(line, line + token.count("\n") + (1 if token != "\n" else 0)))
        line += token.count("\n")
        i = end
    comment -= code
    lines = text.count("\n") + 1
    return lines, lines - len(comment) - len(code), len(comment), len(code)


def test_line_classes_match_a_reader_by_characters(spark):
    rnd = random.Random(5)
    kinds = {"ts": ("//", True, "`"), "java": ("//", True, ()), "py": ("#", False, ('"""', "'''")), "sh": ("#", False, ())}
    rows = []
    for i in range(600):
        lang = rnd.choice(list(kinds))
        pieces = ["/*", "*/", "//", "#", "--", '"', "'", "`", '"""', "\n", "\n", "\n", " ", "x", "ab c", "-", "/", "*", "\\"]
        rows.append(("r", "s", str(i), lang, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(40)))))
    long = "x = `" + "\\`" * 100_000 + "`; /*" + "*\n" * 100_000 + "*/"
    rows.append(("r", "s", "600", "ts", long))
    df = spark.createDataFrame(rows, "repo string, snapshot_id string, path string, language string, content string")
    got = {r.path: (r.lines, r.blanks, r.comments, r.code) for r in corpus.line_stats(df).collect()}
    for _, _, path, lang, text in rows[:-1]:
        assert got[path] == _classes(text, *kinds[lang]), (lang, text)
    assert got["600"] == (100_001, 0, 100_000, 1)


def test_workspaces_and_strict_mode(spark):
    from codehealth.operators import unused as un
    rows = lambda xs, cols: spark.createDataFrame([("r", "s", *x) for x in xs],
                                                  "repo string, snapshot_id string, " + cols)
    used = rows([("a.ts", "root"), ("a/x/f.ts", "root"), ("a/x/f.ts", "own"), ("a/x/deep/g.ts", "own"), ("a/x/f.ts", "tool"),
                 ("b/h.ts", "own"), ("b/h.test.ts", "only-test"), (None, "n"), ("b/h.ts", None), ("ab/k.ts", "root")],
                "file string, package string")
    declared = rows([(".", "root", "dependencies"), (".", "idle", "dependencies"), ("a/x", "own", "dependencies"),
                     ("a/x", "tool", "devDependencies"), ("b", "only-test", "dependencies"), ("b", None, "dependencies")],
                    "manifest string, package string, kind string")
    manifests = rows([(".",), ("a/x",), ("b",), ("a/x",)], "folder string")
    got = lambda **k: sorted((r.file, r.kind, r.name) for r in
                             un.workspace_issues(used, declared, manifests, **k).collect())
    loose = [("b/h.ts", "unlisted", "own"), ("package.json", "dependencies", "idle")]
    assert got() == loose
    assert got(strict=True) == [("a/x/f.ts", "unlisted", "root"), ("a/x/f.ts", "unlisted", "tool"),
                                ("b/h.ts", "unlisted", "own"), ("b/package.json", "dependencies", "only-test"),
                                ("package.json", "dependencies", "idle")]
    assert got(workspace="b") == loose[:1]
    none = un.workspace_issues(used, declared.limit(0), manifests.limit(0))
    assert none.count() == 8 and none.filter("kind <> 'unlisted'").count() == 0


def test_overview_files(spark):
    df = spark.createDataFrame([("r", "s", "a", "ts", "x\ny"), ("r", "s", "b", "ts", "x\ny"), ("r", "s", "c", "ts", "z" * 999),
                                ("r", "s", "d", "ts", "// @generated\nx")],
                               "repo string, snapshot_id string, path string, language string, content string")
    paths = lambda x: sorted(r.path for r in x.collect())
    assert paths(corpus.overview_files(df)) == ["a", "b"]
    assert paths(corpus.overview_files(df, no_duplicates=True)) == ["a"]
    assert paths(corpus.overview_files(df, no_min_gen=False)) == ["a", "b", "c", "d"]


def test_flatten_unused_items_and_labels(spark):
    from codehealth.plans.dashboard import unused_items
    doc = {"files": [], "issues": [{"file": "src/app.ts", "exports": [{"name": "unusedThing", "line": 9}],
                                    "enumMembers": {"Status": [{"name": "Old"}]}, "unlisted": ["left-pad"]}]}
    items = rp.unused_report_items(_reports(spark, doc))
    got = sorted((r.kind, r.name, r.line) for r in items.collect())
    assert got == [("enumMembers", "Old", None), ("exports", "unusedThing", 9), ("unlisted", "left-pad", None)]
    labels = sorted(r.label for r in unused_items(items).collect())
    assert labels == ["Unlisted dependency: left-pad", "Unused enum member: Old",
                      "Unused export: unusedThing (line 9)"]


def test_artifact_selection_and_fallback(spark):
    arts = spark.createDataFrame([
        ("r", "s1", 0, "stats-lines", "L"), ("r", "s1", 1, "stats-complexity", "C"),
        ("r", "s2", 0, "stats-lines", "L2"), ("r", "s2", 1, "unused", "U")],
        "repo string, snapshot_id string, check_idx int, artifact_id string, raw string")
    got = {r.snapshot_id: r.raw for r in rp.stats_artifact(arts).collect()}
    assert got == {"s1": "C", "s2": "L2"}
    declared = spark.createDataFrame([("r", "s2", "unused")], "repo string, snapshot_id string, artifact_id string")
    assert [r.raw for r in rp.select_artifacts(declared, arts).collect()] == ["U"]
    assert rp.first_artifact(arts, "stats-lines").filter("snapshot_id = 's1'").first().raw == "L"


def test_scan_source_files(spark, tmp_dir):
    import os
    from codehealth.sources.files import scan_source_files
    os.makedirs(os.path.join(tmp_dir, "src", "lib"))
    for rel, text in (("src/a.ts", "let a = 1\n"), ("src/lib/b.js", "if (x) {}\n"), ("src/readme.md", "# x\n"),
                      ("other.ts", "x\n")):
        with open(os.path.join(tmp_dir, rel), "w") as fh:
            fh.write(text)
    got = sorted(r.path for r in scan_source_files(spark, tmp_dir, "r", "s").collect())
    assert got == ["src/a.ts", "src/lib/b.js"]


def test_weak_and_strict_modes_differ(spark):
    from codehealth.operators.clones import normalised_lines
    df = spark.createDataFrame([("r", "s", "f", "a\n\n// c\n  b  ")],
                               "repo string, snapshot_id string, path string, content string")
    n = {m: [x.t for x in normalised_lines(df, m).first().arr] for m in ("strict", "mild", "weak")}
    assert n == {"strict": ["a", "", "// c", "  b  "], "mild": ["a", "// c", "b"], "weak": ["a", "b"]}


def test_malformed_unused_report_has_no_metrics(spark):
    df = spark.createDataFrame([("r", "s1", "{not json"), ("r", "s2", '{"files":["a"]}'), ("r", "s3", "null"),
                                ("r", "s4", '{"files":["a"]}'), ("r", "s4", ""), ("r", "s5", None)],
                               "repo string, snapshot_id string, raw string")
    assert [(r.snapshot_id, r.unused_files, r.total_issues) for r in rp.unused_report_metrics(df).collect()] == [("s2", 1, 1)]
    assert [r.snapshot_id for r in rp.unused_counts_by_file(df).collect()] == ["s2"]


def test_entries_at_any_depth(spark):
    deep = {"exports": {"name": "foo"}, "enumMembers": {"A": {"B": {"C": {"D": {"E": [{"name": "x", "line": 3}, "y"]}}}}},
            "types": [[["t"]], {"col": 4}, 7, None], "file": "f.ts"}
    doc = {"files": {"group": [{"path": "gone.ts"}, "other.ts"]}, "issues": [deep, None, 5]}
    got = sorted((r.file, r.kind, r.name or "", r.line or 0) for r in rp.unused_report_items(_reports(spark, doc)).collect())
    assert got == [("f.ts", "enumMembers", "x", 3), ("f.ts", "enumMembers", "y", 0), ("f.ts", "exports", "foo", 0),
                   ("f.ts", "types", "", 0), ("f.ts", "types", "t", 0), ("gone.ts", "files", "", 0),
                   ("other.ts", "files", "", 0)]
    assert rp.unused_report_metrics(_reports(spark, doc)).count() == 0  # a null issue makes it malformed
    doc["issues"].remove(None)
    m = rp.unused_report_metrics(_reports(spark, doc)).first()
    assert (m.unused_files, m.unused_exports, m.unused_types) == (2, 2, 4)


def test_package_kinds_over_several_manifests(spark):
    from codehealth.operators import unused as un
    rows = lambda xs, cols: spark.createDataFrame([("r", "s", *x) for x in xs],
                                                  "repo string, snapshot_id string, " + cols)
    used = rows([("a/x.ts", "lib"), ("a/x.ts", "peer"), ("a/x.ts", "both"), ("a/x.ts", "gone"), ("b/y.ts", "peer"), (None, "n"), ("b/y.ts", None)],
                "file string, package string")
    scripts = rows([("a", "lint"), ("a", "lint"), ("b", "lint"), ("b", "build"), (".", "pack"), ("b", None)], "manifest string, binary string")
    declared = rows([(".", "lib", "dependencies", None), (".", "bundler", "devDependencies", "catalog:"), ("a", "linter", "devDependencies", "catalog:old"),
                     ("a", "peer", "optionalPeerDependencies", "^1"), ("a", "both", "optionalPeerDependencies", "^1"), (".", "both", "dependencies", "catalog:"),
                     ("b", "idle", "dependencies", "1"), ("b", "idle", "dependencies", "1"), ("b", "lib", "dependencies", "1"), ("b", None, "dependencies", "1")],
                    "manifest string, package string, kind string, spec string")
    folders = rows([(".",), ("a",), ("b",)], "folder string")
    provided = rows([("linter", "lint"), ("other", "lint"), ("bundler", "build"), ("bundler", "bundle")], "package string, binary string")
    catalog = rows([("default", "bundler"), ("default", "linter"), ("old", "linter"), ("old", "both"), ("default", "both")], "catalog string, package string")
    out = un.manifest_issues(used, scripts, declared, folders, provided, catalog)
    got = sorted((r.file, r.kind, r.name) for r in out.collect())
    assert got == sorted([
        ("b/package.json", "dependencies", "idle"), ("b/package.json", "dependencies", "lib"),
        ("a/x.ts", "optionalPeerDependencies", "peer"), ("a/x.ts", "unlisted", "gone"), ("b/y.ts", "unlisted", "peer"),
        ("b/package.json", "binaries", "lint"), ("package.json", "binaries", "pack"),
        ("package.json", "catalog", "default.linter"), ("package.json", "catalog", "old.both")])
    none = un.manifest_issues(*[x.limit(0) for x in (used, scripts, declared, folders, provided, catalog)])
    assert none.count() == 0 and none.columns == ["repo", "snapshot_id", "file", "kind", "name"]


def test_display_order_of_children(spark):
    from codehealth.operators import tree as tree_ops
    names = ["B", "a", "_x", "A", "b", "a-b", "é", "z"]
    stats = spark.createDataFrame([("r", "s", f"src/{n}", 1, 1, 1) for n in names] + [("r", "s", "src/Zdir/k", 1, 1, 1)],
                                  "repo string, snapshot_id string, path string, lines int, code int, complexity int")
    tree = tree_ops.build_tree(tree_ops.contributions(stats, None))
    listed = lambda *c: [r.child[4:] for r in tree_ops.child_order(tree, *c).filter("parent = 'src'").orderBy("position").collect()]
    assert listed("UNICODE") == ["Zdir", "_x", "a", "A", "a-b", "b", "B", "é", "z"]
    assert listed() == ["Zdir", *sorted(names)]
