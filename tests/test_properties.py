"""Property tests: roll-up invariants on random trees."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codehealth.operators import tree as tr

segment = st.sampled_from(["a", "b", "c", "lib", "ui"])
paths = st.lists(segment, min_size=1, max_size=4).map(lambda parts: "src/" + "/".join(parts) + ".ts")
rows = st.lists(st.tuples(paths, st.integers(0, 500), st.integers(0, 50), st.integers(0, 3)),
                min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_rollup_invariants(spark, data):
    df = spark.createDataFrame([("r", "s", p, lines, lines // 2, cx, u, 0, 0) for p, lines, cx, u in data],
                               "repo string, snapshot_id string, path string, lines long, code long, "
                               "complexity long, unused long, duplication long, cycles long")
    tree = {r.path: r for r in tr.build_tree(tr.contributions_wide(df), root="src").collect()}
    root = tree["src"]
    assert root.lines == sum(x[1] for x in data)
    assert root.files == len(data)  # every stats row counts once at the root
    assert root.unused == sum(x[3] for x in data)
    # a node that is only a directory sums exactly its direct children
    kids = {}
    for n in tree.values():
        if n.parent is not None:
            kids.setdefault(n.parent, []).append(n)
    for path, n in tree.items():
        if n.kind == "dir":
            assert n.lines == sum(c.lines for c in kids.get(path, []))
            assert n.total == sum(c.total for c in kids.get(path, []))
