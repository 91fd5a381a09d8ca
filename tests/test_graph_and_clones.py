"""Graph and clone operators against brute force on small inputs."""

import random
import re

from pyspark.sql import functions as F

from codehealth.operators import clones as cl
from codehealth.operators import depgraph as g
from codehealth.params import CloneParams, Rule


def _closure(edges):
    succ = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)
    reach = {}
    for s in {a for a, _ in edges} | {b for _, b in edges}:
        seen, stack = set(), [s]
        while stack:
            for n in succ.get(stack.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        reach[s] = seen
    return reach


def test_circular_edges_match_brute_force(spark):
    rnd = random.Random(7)
    edges = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)})
    reach = _closure(edges)
    expected = {(a, b) for a, b in edges if a in reach.get(b, set())}
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {(r.src, r.dst) for r in g.circular_edges(df).collect()}
    assert got == expected


def test_components_invariant_under_edge_order(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)]
    a = {(r.node, r.component) for r in g.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    b = {(r.node, r.component) for r in
         g.components(spark.createDataFrame(list(reversed(edges)), "src long, dst long")).collect()}
    assert a == b
    groups = {}
    for n, c in a:
        groups.setdefault(c, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5]]


def test_self_loop_is_circular(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")
    assert {(r.src, r.dst) for r in g.circular_edges(df).collect()} == {(1, 1)}


def test_reachability_matches_brute_force(spark):
    rnd = random.Random(3)
    edges = sorted({(rnd.randrange(50), rnd.randrange(50)) for _ in range(60)})
    reach = _closure(edges)
    starts = [0, 1, 2]
    expected = set(starts)
    for s in starts:
        expected |= reach.get(s, set())
    got = {r.node for r in g.reachable(spark.createDataFrame(edges, "src long, dst long"),
                                       spark.createDataFrame([(s,) for s in starts], "node long")).collect()}
    assert got == expected


def _chained_graphs(seed, n_graphs=60):
    """Disjoint random graphs whose edges are cut into chains, with rings, trees,
    loops through one node and repeated edges among them."""
    rnd = random.Random(seed)
    edges, base = [], 0
    for _ in range(n_graphs):
        n = rnd.randrange(1, 9)
        last = base + n
        for _ in range(rnd.randrange(1, 2 * n + 2)):
            a, b = base + rnd.randrange(n), base + rnd.randrange(n)
            for _ in range(rnd.choice([0, 0, 1, 3, 12])):
                edges.append((a, last))
                a, last = last, last + 1
            edges.append((a, b))
        size = rnd.randrange(2, 20)
        edges += [(last + i, last + (i + 1) % size) for i in range(size)]
        if rnd.random() < 0.5:
            edges.append((last, last + size))
        base = last + size + 1
    ids = list(range(base))
    rnd.shuffle(ids)
    return [(ids[a], ids[b]) for a, b in edges], ids


def test_chains_rings_and_loops_match_brute_force(spark):
    edges, ids = _chained_graphs(11)
    reach = _closure(edges)
    df = spark.createDataFrame(edges + edges[:50], "src long, dst long")
    got = {(r.src, r.dst) for r in g.circular_edges(df).collect()}
    assert got == {(a, b) for a, b in edges if a in reach.get(b, set())}
    comp = [(r.node, r.component) for r in g.components(df).collect()]
    groups = {}
    for n, c in comp:
        groups.setdefault(c, []).append(n)
    expected = {frozenset(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in expected if len(x) > 1)
    assert all(c in members for c, members in groups.items())
    starts = ids[::17] + [-5]
    expected = set(starts).union(*(reach.get(x, set()) for x in starts))
    found = [r.node for r in g.reachable(df, spark.createDataFrame([(x,) for x in starts + starts[:3]],
                                                                   "node long")).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_graph_searches_on_empty_tables(spark):
    none = spark.createDataFrame([], "src long, dst long")
    one = spark.createDataFrame([(3,)], "node long")
    assert g.components(none).count() == 0
    assert [r.node for r in g.reachable(none, one).collect()] == [3]
    assert g.reachable(spark.createDataFrame([(3, 4)], "src long, dst long"), one.limit(0)).count() == 0


def test_cycle_counts_pairs_once_self_loop_twice(spark):
    df = spark.createDataFrame([("r", "s", "a", "b"), ("r", "s", "b", "a"), ("r", "s", "c", "c"), ("r", "t", "a", "b")],
                               "repo string, snapshot_id string, src_path string, dst_path string")
    got = {(r.snapshot_id, r.path): r.cycles for r in g.cycle_counts_by_file(df).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 1, ("s", "c"): 2, ("t", "a"): 1, ("t", "b"): 1}


def _files(spark, docs):
    return spark.createDataFrame([("r", "s", p, c) for p, c in docs],
                                 "repo string, snapshot_id string, path string, content string")


def test_clone_detection_finds_shared_block_once_per_copy(spark):
    block = "\n".join(f"let value{i} = compute(alpha, beta, gamma, delta, {i});" for i in range(8))
    docs = [("src/a.ts", "head a\n" + block + "\ntail a"),
            ("src/b.ts", "x\ny\n\n" + block),
            ("src/c.ts", block + "\nz")]
    got = cl.clone_pairs(_files(spark, docs), CloneParams(min_lines=5, min_tokens=20)).collect()
    assert len(got) == 2  # m copies -> m - 1 pairs, all against the first occurrence
    by_second = {r.second_file: r for r in got}
    assert set(by_second) == {"src/b.ts", "src/c.ts"}
    assert all(r.first_file == "src/a.ts" and (r.first_start, r.first_end) == (2, 9) for r in got)
    assert (by_second["src/b.ts"].second_start, by_second["src/b.ts"].second_end) == (4, 11)
    assert by_second["src/c.ts"].norm_lines == 8


def test_clone_ranges_are_equal_text(spark):
    block = "\n".join(f"return handler{i}(request, response, next, options);" for i in range(6))
    docs = [("src/x.ts", block + "\nend"), ("src/y/z.ts", "start\n" + block)]
    got = cl.clone_pairs(_files(spark, docs), CloneParams(min_lines=5, min_tokens=10)).collect()
    texts = dict(docs)
    for r in got:
        a = texts[r.first_file].split("\n")[r.first_start - 1:r.first_end]
        b = texts[r.second_file].split("\n")[r.second_start - 1:r.second_end]
        assert [x.strip() for x in a if x.strip()] == [x.strip() for x in b if x.strip()]
    skipped = cl.clone_pairs(_files(spark, docs), CloneParams(min_lines=5, min_tokens=10, skip_local=True))
    assert skipped.count() == len(got)  # different folders
    counts = {r.path: r.duplication for r in cl.clone_counts_by_file(
        spark.createDataFrame([("r", "s", "f", "f")], "repo string, snapshot_id string, first_file string, "
                                                        "second_file string")).collect()}
    assert counts == {"f": 2}  # a self-clone counts twice


def test_many_snapshots_in_one_pass(spark):
    rows = [("r", "s1", "a", "b"), ("r", "s1", "b", "a"), ("r", "s1", "b", "c"),
            ("r", "s2", "a", "b"), ("r", "s2", "b", "c"), ("r", "s2", "c", "a")]
    df = spark.createDataFrame(rows, "repo string, snapshot_id string, src_path string, dst_path string")
    e, nodes = g.index_nodes(df)
    circ = g.circular_edges(e)
    named = (circ.join(nodes.select(F.col("node").alias("src"), "snapshot_id", F.col("path").alias("s")), "src")
             .join(nodes.select(F.col("node").alias("dst"), F.col("path").alias("d")), "dst"))
    got = sorted((r.snapshot_id, r.s, r.d) for r in named.collect())
    assert got == [("s1", "a", "b"), ("s1", "b", "a"),
                   ("s2", "a", "b"), ("s2", "b", "c"), ("s2", "c", "a")]


def test_long_files_and_ignored_text(spark):
    from codehealth.operators import clones

    long = "\n".join(f"call_{i}(a, b, c);" for i in range(1200))
    block = "\n".join(f"copied line {i} = x + {i};" for i in range(20))
    cols = "repo string, snapshot_id string, path string, content string"
    files = spark.createDataFrame([("r", "s", "a.ts", long), ("r", "s", "b.ts", long)], cols)
    got = clones.clone_pairs(files).collect()
    assert [(r["first_start"], r["first_end"]) for r in got] == [(1, 1200)]
    files = spark.createDataFrame([("r", "s", p, f"{p} own\n{block}\nCopyright {p}") for p in ("a.ts", "b.ts")], cols)
    assert clones.clone_pairs(files, CloneParams(ignore_pattern="Copyright")).count() == 1


def test_lines_in_two_clones_count_once(spark):
    shared = [f"shared_{i}(alpha, beta, gamma, {i});" for i in range(20)]
    docs = [("src/a.ts", "\n".join(shared[7:13])), ("src/b.ts", "\n".join(shared)), ("src/c.ts", "\n".join(shared))]
    files = _files(spark, docs)
    clones = cl.clone_pairs(files, CloneParams(min_lines=5, min_tokens=100))
    totals = cl.duplication_totals(clones, files).first()
    assert (totals.total_lines, totals.duplicated_lines_percent) == (46, 43.48)


def test_spans_of_many_clones_are_joined(spark):
    clones = spark.createDataFrame([("r", "s", "f", 1, 10), ("r", "s", "f", 3, 5), ("r", "s", "f", 8, 12),
                                    ("r", "s", "f", 20, 21), ("r", "t", "f", 2, 2)],
                                   "repo string, snapshot_id string, second_file string, second_start long, second_end long")
    got = sorted((r.snapshot_id, r.start, r.end) for r in cl._covered(clones).collect())
    assert got == [("s", 1, 12), ("s", 20, 21), ("t", 2, 2)]


def test_rankings_are_per_snapshot(spark):
    rows = [("r", s, p, i, 1, v, False) for s in ("s1", "s2") for i, (p, v) in enumerate((("a", 0.5), ("b", 0.9)))]
    files = spark.createDataFrame(rows, "repo string, snapshot_id string, path string, dependencies long, "
                                        "dependents long, instability double, in_cycle boolean")
    assert sorted((r.snapshot_id, r.path) for r in g.highly_unstable(files, 1).collect()) == [("s1", "b"), ("s2", "b")]
    assert sorted((r.snapshot_id, r.path) for r in g.stable_depended_on(files, 1).collect()) == [("s1", "a"), ("s2", "a")]


def test_captured_text_of_a_rule_is_literal(spark):
    edges = spark.createDataFrame([("r", "s", "src/a.b/x", "src/a.b/y"), ("r", "s", "src/a.b/x", "src/aXb/y")],
                                  "repo string, snapshot_id string, src_path string, dst_path string")
    got = g.rule_violations(edges, "own-folder", "^src/([^/]+)/", "^src/$1/").collect()
    assert [r.dst_path for r in got] == ["src/aXb/y"]


def test_rule_set(spark):
    edges = spark.createDataFrame(
        [("r", "s", "src/features/a.b/x", "src/features/a.b/y", None),
         ("r", "s", "src/features/a.b/x", "src/features/aXb/y", True),
         ("r", "s", "src/features/a", "src/lib/a|", False), ("r", "s", None, "src/ui/x", False),
         ("r", "t", "src/domain/x", "src/ui/x", False), ("r", "u", "lib/x", "src/ui/x", False)],
        "repo string, snapshot_id string, src_path string, dst_path string, circular boolean")
    rules = [Rule("own", "warn", "^src/features/([^/]+)/", "^src/features/([^/]+)/", "^src/features/$1/"),
             Rule("domain", "error", "^src/domain", "^src/ui"), Rule("loops", "error", circular=True),
             Rule("straight", "info", "^src/features", circular=False), Rule("off", "ignore")]
    broken = g.rule_set_violations(edges, rules)
    assert sorted((r.snapshot_id, r.rule, r.severity, r.dst_path) for r in broken.collect()) == [
        ("s", "loops", "error", "src/features/aXb/y"), ("s", "own", "warn", "src/features/aXb/y"),
        ("s", "straight", "info", "src/features/a.b/y"), ("s", "straight", "info", "src/lib/a|"),
        ("t", "domain", "error", "src/ui/x")]
    assert sorted((r.snapshot_id, r.error, r.warn, r.info, r.passes) for r in
                  g.rule_summary(edges, broken).collect()) == [
        ("s", 1, 1, 2, False), ("t", 1, 0, 0, False), ("u", 0, 0, 0, True)]
    assert g.rule_set_violations(edges, []).count() == 0


def test_templates_equal_a_pattern_for_each_row(spark):
    groups = ["a", "a.b", "x+", "", "$1", "a|b", "Brand#1"]
    paths = [f"src/{x}{y}" for x in groups for y in ("", "/", "/f", "1", "1/", "|", "/a", "b")]
    templates = ["^src/$1/", "^src/$1", r"^src/$1(\d|/)", "^src/$1|x", "^src/$1?/", "$1$", r"^s.c/$1/", "^src/$1/$1",
                 r"^src\/$1(?:/|\|)$", "^src/$1/[^|]*$", "(^src/$1)/"]
    df = spark.createDataFrame([(a, b) for a in groups for b in paths], "g string, path string")
    cols = [g._matches(F.col("path"), t, F.col("g")).alias(f"t{i}") for i, t in enumerate(templates)]
    for r in df.select("g", "path", *cols).collect():
        for i, t in enumerate(templates):
            expected = re.search(t.replace("$1", re.escape(r.g)), r.path) is not None
            assert r[f"t{i}"] == expected, (t, r.g, r.path)


def test_a_hub_and_a_long_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(200, 240)] + [(1, 200), (240, 0)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.src, r.dst) for r in g.circular_edges(df).collect()} == {(0, 1), (1, 200), (240, 0)} | {
        (i, i + 1) for i in range(200, 240)}
    assert g.reachable(df, spark.createDataFrame([(1,)], "node long")).count() == 241


def test_clone_run_is_not_broken_by_a_third_file(spark):
    block = [f"let value{i} = compute(alpha, beta, gamma);" for i in range(20)]
    docs = [("src/a.ts", "\n".join(block[7:13])), ("src/b.ts", "\n".join(block)), ("src/c.ts", "\n".join(block))]
    files = _files(spark, docs)
    got = cl.clone_pairs(files, CloneParams(min_tokens=100))
    assert [(r.first_file, r.second_file, r.second_start, r.second_end) for r in got.collect()] == \
        [("src/b.ts", "src/c.ts", 1, 20)]
    totals = cl.duplication_totals(got, files).first()
    assert (totals.clones, totals.duplicated_lines_percent) == (1, 43.48)
    # with few tokens asked for, the part that a holds is a clone of its own
    short = cl.clone_pairs(files, CloneParams(min_tokens=50)).collect()
    assert sorted((r.first_file, r.second_file, r.lines) for r in short) == \
        [("src/a.ts", "src/b.ts", 6), ("src/b.ts", "src/c.ts", 20)]


def test_clones_within_one_file_and_formats(spark):
    block = "\n".join(f"let value{i} = compute(alpha, beta, gamma, {i});" for i in range(6))
    files = _files(spark, [("src/a.ts", block + "\nmiddle\n" + block), ("src/b.md", block),
                           ("src/same.ts", "\n".join(["repeat(the, same, line, again);"] * 300))])
    got = cl.clone_pairs(files, CloneParams(min_tokens=20, formats=("ts",))).collect()
    assert sorted((r.first_file, r.second_file, r.second_start, r.second_end) for r in got) == \
        [("src/a.ts", "src/a.ts", 8, 13), ("src/same.ts", "src/same.ts", 2, 300)]
    assert cl.clone_pairs(files.limit(0)).count() == 0


def test_copies_between_smaller_and_larger_holders_are_found(spark):
    block = [f"let value{i} = compute(alpha, beta, gamma, {i});" for i in range(30)]
    parts = {"a": (0, 12), "b": (8, 22), "c": (18, 30), "m": (0, 30), "n": (0, 30), "x": (0, 12), "y": (8, 22), "z": (18, 30)}
    files = _files(spark, [(f"src/{f}.ts", "\n".join([f"own {f}", *block[i:j], f"end {f}"])) for f, (i, j) in parts.items()])
    params = CloneParams(min_tokens=20)
    rows = cl.clone_pairs(files, params).collect()
    got = {(r.first_file[4], r.second_file[4], r.second_start, r.second_end) for r in rows}
    assert got >= {("m", "n", 2, 31), ("a", "x", 2, 13), ("b", "y", 2, 15), ("c", "z", 2, 13), ("a", "m", 2, 13), ("b", "m", 10, 23), ("c", "m", 20, 31)}
    assert not any(r.second_file == "src/n.ts" and r.norm_lines < 30 for r in rows)  # parts of the whole copy
    classes = {(r.first_file[4], r.norm_lines): r.places for r in cl.clone_classes(files, params).collect()}
    assert classes[("m", 30)] == 2 and classes[("a", 12)] == classes[("c", 12)] == 4 and classes[("b", 14)] == 4


def test_clones_equal_a_comparison_of_all_places(spark):
    """Every two places whose equal run can't be made longer lie in one class, by way of links of at least that length."""
    import random
    r = random.Random(7)
    for k in (2, 3):
        texts = {f"f{i}": [r.choice("abc") * 3 for _ in range(r.randrange(1, 25))] for i in range(6)} | {"g": ["abc"] * 40, "h": []}
        files = _files(spark, [(f, "\n".join(x)) for f, x in texts.items()])
        runs = cl._clones(cl.normalised_lines(files), k).collect()
        near = {}
        for run in runs:
            n = run.end_pos - run.start_pos + 1
            a, b = (run.first_file, run.first_pos), (run.second_file, run.start_pos)
            assert texts[a[0]][a[1] - 1:a[1] - 1 + n] == texts[b[0]][b[1] - 1:b[1] - 1 + n]
            for i in range(n - k + 1):  # a run links its inner places too
                near.setdefault((a[0], a[1] + i), []).append(((b[0], b[1] + i), n - i))
                near.setdefault((b[0], b[1] + i), []).append(((a[0], a[1] + i), n - i))
        places = [(f, i + 1) for f, x in texts.items() for i in range(len(x))]
        count = 0
        for a in places:
            for b in places:
                n = 0
                while a != b and a[1] + n <= len(texts[a[0]]) and b[1] + n <= len(texts[b[0]]) and texts[a[0]][a[1] + n - 1] == texts[b[0]][b[1] + n - 1]:
                    n += 1
                if n < k or a[1] > 1 and b[1] > 1 and texts[a[0]][a[1] - 2] == texts[b[0]][b[1] - 2]:
                    continue
                seen, todo = {a}, [a]
                while todo:
                    for c, length in near.get(todo.pop(), []):
                        if length >= n and c not in seen:
                            seen.add(c)
                            todo.append(c)
                assert b in seen, (k, a, b, n)
                count += 1
        assert count > len(runs) > 10
