"""Dependency-graph operators: coupling, instability, circular edges,
reachability, scoped / collapsed / focused views and rule checks.

Graphs are edge tables ``(src, dst)`` of node ids plus a ``modules(repo,
snapshot_id, node, path)`` table. An id belongs to one snapshot, so the graphs of
all snapshots form one disjoint union and every result is per snapshot. The iterative algorithms (strongly connected components and
reachability) are driver loops over DataFrames: every step is a join plus an
aggregation on the executors, the driver only sees a "did anything change"
flag per step. Every step is written as columnar files into the
session's checkpoint directory, so a lost executor recomputes one step, not
the whole history.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from codehealth.params import SEVERITIES, Rule
from codehealth.session import saved

SNAP = ["repo", "snapshot_id"]


# ---- filters on edges (P4, G3, G5) ----------------------------------------------
def with_paths(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Attach repo, snapshot_id, src_path and dst_path to node-id edges (an id is
    unique over all snapshots)."""
    src = modules.select(F.col("node").alias("src"), *SNAP, F.col("path").alias("src_path"))
    dst = modules.select(F.col("node").alias("dst"), F.col("path").alias("dst_path"))
    return edges.select("src", "dst").join(src, "src").join(dst, "dst")


def filter_edges(edges: DataFrame, include_only: str | None = None, exclude: str | None = None,
                 do_not_follow: str | None = None) -> DataFrame:
    """Include-only (both ends), exclude (either end), do-not-follow
    (drop the out-edges of matching modules; the modules stay)."""
    out = edges
    if include_only:
        out = out.filter(F.col("src_path").rlike(include_only) & F.col("dst_path").rlike(include_only))
    if exclude:
        out = out.filter(~(F.col("src_path").rlike(exclude) | F.col("dst_path").rlike(exclude)))
    if do_not_follow:
        out = out.filter(~F.col("src_path").rlike(do_not_follow))
    return out


def scope(edges_p: DataFrame, prefix_regex: str) -> DataFrame:
    """Edges with both ends inside the scope."""
    return edges_p.filter(F.col("src_path").rlike(prefix_regex) & F.col("dst_path").rlike(prefix_regex))


def focus(edges_p: DataFrame, focus_regex: str) -> DataFrame:
    """The focused modules and their depth-1 neighbours in both directions."""
    return edges_p.filter(F.col("src_path").rlike(focus_regex) | F.col("dst_path").rlike(focus_regex))


def collapse_layers(edges_p: DataFrame, pattern: str = "^src/[^/]+/") -> DataFrame:
    """Map each path to its layer (first match of the pattern, or the path
    itself), count distinct module edges between different layers of a snapshot."""
    def layer(c):
        hit = F.regexp_extract(F.col(c), pattern, 0)
        return F.when(hit == "", F.col(c)).otherwise(hit)
    return (edges_p.select(*SNAP, layer("src_path").alias("src_layer"), layer("dst_path").alias("dst_layer"))
            .filter(F.col("src_layer") != F.col("dst_layer"))
            .groupBy(*SNAP, "src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("weight")))


# ---- coupling and instability (G2, A16, A6, T3, T4) --------------------------------
def coupling(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Per module efferent (dependencies), afferent (dependents) coupling
    and instability Ce / (Ca + Ce), 0 for an isolated module."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("dependencies")).withColumnRenamed("src", "node")
    inn = e.groupBy("dst").agg(F.count(F.lit(1)).alias("dependents")).withColumnRenamed("dst", "node")
    m = (modules.select(*SNAP, "node", "path").join(out, "node", "left").join(inn, "node", "left")
         .fillna(0, subset=["dependencies", "dependents"]))
    total = F.col("dependencies") + F.col("dependents")
    return m.withColumn("instability", F.when(total > 0, F.col("dependencies") / total).otherwise(F.lit(0.0)))


def instability_by_file(coupled: DataFrame, circular: DataFrame) -> DataFrame:
    """Coupling plus inCycle = the module has an outgoing circular edge."""
    in_cycle = circular.select(F.col("src").alias("node")).distinct().withColumn("in_cycle", F.lit(True))
    return (coupled.join(in_cycle, "node", "left")
            .withColumn("in_cycle", F.coalesce(F.col("in_cycle"), F.lit(False))))


def instability_summary(by_file: DataFrame) -> DataFrame:
    """Per snapshot files, files in cycles, average instability, max out / in degree."""
    return by_file.groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("in_cycle")).alias("files_in_cycles"),
        F.round(F.avg("instability"), 6).alias("average_instability"),
        F.max("dependencies").cast("bigint").alias("highest_dependencies"),
        F.max("dependents").cast("bigint").alias("highest_dependents"))


def _first_of_snapshot(rows: DataFrame, order: list, limit: int) -> DataFrame:
    # row_number <= limit is a partial WindowGroupLimit before the shuffle
    w = Window.partitionBy(*SNAP).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w).cast("bigint")).filter(F.col("position") <= limit)


def highly_unstable(by_file: DataFrame, limit: int = 25) -> DataFrame:
    """Per snapshot by instability desc, dependencies desc, dependents desc, path asc."""
    return _first_of_snapshot(by_file, [F.desc("instability"), F.desc("dependencies"), F.desc("dependents"),
                                        F.asc("path")], limit)


def stable_depended_on(by_file: DataFrame, limit: int = 25) -> DataFrame:
    """T4: dependents > 0; per snapshot by dependents desc, instability asc, dependencies asc, path asc."""
    return _first_of_snapshot(by_file.filter(F.col("dependents") > 0),
                              [F.desc("dependents"), F.asc("instability"), F.asc("dependencies"), F.asc("path")],
                              limit)


# ---- iteration support ---------------------------------------------------------------
class _Steps:
    """Materialise one loop step per Spark job.

    Each step writes its DataFrame as columnar files of the shared folder and, in the same
    job, counts its rows and those whose flag is set, which the loop needs. Nothing is kept
    in executor memory, and no plan or recovery reaches further back than one step.
    """

    def __call__(self, df: DataFrame, flag: str | None = None):
        seen = Observation()
        aggs = [F.count(F.lit(1)).alias("n")]
        if flag:
            aggs.append(F.count_if(F.col(flag)).alias("flag"))
        df = saved(df.observe(seen, *aggs))
        row = seen.get
        return df, row["n"], (row["flag"] if flag else None)


def _big(df: DataFrame) -> DataFrame:
    """The side of a join in a loop: always shuffled, so that steps add nothing to what the driver collects."""
    return df.hint("merge")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- strongly connected components (G1) --------------------------------------------
def _trim(edges: DataFrame, steps: _Steps, gain: float = 0.3) -> DataFrame:
    """Drop edges touching nodes without in- or out-edges. Such nodes are
    singleton components and cannot lie on a cycle. It goes on while a pass removes at
    least ``gain`` of the edges; long dead ends are left to ``_chains``, which makes
    single edges of them. The result is written."""
    e, n, _ = steps(edges)
    while n:
        ends = e.select(F.explode(F.array(
            F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
        live = (ends.groupBy("x.node").agg(F.max("x.o").alias("o"), F.max("x.i").alias("i"))
                .filter("o = 1 AND i = 1").select("node"))
        live, _, _ = steps(live)
        kept = (e.join(_big(live.withColumnRenamed("node", "src")), "src", "left_semi")
                .join(_big(live.withColumnRenamed("node", "dst")), "dst", "left_semi"))
        e, k, _ = steps(kept)
        if n - k < gain * n:
            break
        n = k
    return e


def _label_step(state: DataFrame, both: DataFrame) -> DataFrame:
    """One step of simultaneous forward / backward max-label propagation.

    ``both`` holds every edge twice: (a=src, t=dst, fwd=True) and
    (a=dst, t=src, fwd=False). Only nodes whose label changed meet their edges:
    a changed forward label goes to the successors, a changed backward label to
    the predecessors. The join is inner, so AQE can split a hub's edges.
    """
    changed = state.filter("changed")
    told = (changed.join(_big(both), changed.node == both.a)
            .filter(F.when(F.col("fwd"), F.col("cf")).otherwise(F.col("cb")))
            .select(F.col("t").alias("node"), F.when(F.col("fwd"), F.col("f")).alias("f"),
                    F.when(~F.col("fwd"), F.col("b")).alias("b"), F.lit(False).alias("own")))
    x = state.select("node", "f", "b", F.lit(True).alias("own")).union(told)
    agg = x.groupBy("node").agg(F.max("f").alias("f"), F.max("b").alias("b"),
                               F.max(F.when(F.col("own"), F.col("f"))).alias("f0"),
                               F.max(F.when(F.col("own"), F.col("b"))).alias("b0"))
    return agg.select("node", "f", "b", (F.col("f") > F.col("f0")).alias("cf"),
                      (F.col("b") > F.col("b0")).alias("cb"),
                      ((F.col("f") > F.col("f0")) | (F.col("b") > F.col("b0"))).alias("changed"))


def _chains(edges: DataFrame, steps: _Steps, gain: float = 0.05):
    """Take chains out of a trimmed graph: a node with one in- and one out-edge lies on
    a cycle iff the chain's two ends lie on a common one, so the chain becomes one edge.

    Pointer jumping: every chain node points at its predecessor and takes over its
    pointer until that is the chain's first node; steps grow with the logarithm of the
    longest chain. Rings of such nodes have no first node: their pointers stop settling,
    and the largest id that their windows (doubled in each step) hold names the ring.
    Returns (links(node, head, tail), rings(node, component), shorter edges), or None
    if less than ``gain`` of the edges would go.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(None).alias("up")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("src").alias("up"))
    )).alias("x"))
    inner, n, _ = steps(ends.groupBy("x.node").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i"),
                                                   F.max("x.up").alias("up"))
                        .filter("o = 1 AND i = 1").select("node", "up"))
    if n == 0 or n < gain * edges.count():
        return None
    first = inner.join(_big(inner.select(F.col("node").alias("up"))), "up", "left_anti").select("node", "up")
    top = first.select("node", F.col("up").alias("head"), F.lit(True).alias("is_first"))
    state, _, active = steps(inner.join(_big(top), "node", "left").select(
        "node", F.when(F.col("is_first"), F.col("node")).otherwise(F.col("up")).alias("ptr"),
        F.greatest("node", "up").alias("m"), F.coalesce("is_first", F.lit(False)).alias("done"))
        .withColumn("active", ~F.col("done")), "active")
    done, rest = [state.filter("done")], state.filter(~F.col("done"))
    while active:
        other = _all([*done, rest]).select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("m").alias("m2"),
                                           F.col("done").alias("done2"))
        # a step rewrites unsettled nodes only; a node is active if it settles now or its window grew
        state, _, active = steps(rest.join(_big(other), "ptr").select(
            "node", F.col("ptr2").alias("ptr"), F.greatest("m", "m2").alias("m"), F.col("done2").alias("done"),
            (F.col("done2") | (F.col("m2") > F.col("m"))).alias("active")), "active")
        done.append(state.filter("done"))
        rest = state.filter(~F.col("done"))
    rings = rest.select("node", F.col("m").alias("component"))
    chain = _all(done).select("node", F.col("ptr").alias("chain"))
    heads = top.select(F.col("node").alias("chain"), "head")
    named, _, _ = steps(chain.join(_big(heads), "chain"))                 # node, chain, head
    out = (edges.join(_big(inner.select(F.col("node").alias("dst"))), "dst", "left_anti")
           .join(_big(named.withColumnRenamed("node", "src")), "src", "left")
           .select(F.coalesce("head", "src").alias("src"), "dst", "chain"))
    out, _, _ = steps(out)
    links = (named.join(_big(out.filter(F.col("chain").isNotNull()).select("chain", F.col("dst").alias("tail"))), "chain")
             .select("node", "head", "tail"))
    links, _, _ = steps(links)
    return links, rings, out.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def _put_back(comp: DataFrame, links: DataFrame, rings: DataFrame) -> DataFrame:
    """Components of a graph from those of the graph without its chains."""
    ends = (links.join(_big(comp.select(F.col("node").alias("head"), F.col("component").alias("c1"))), "head", "left")
            .join(_big(comp.select(F.col("node").alias("tail"), F.col("component").alias("c2"))), "tail", "left"))
    inside = ends.filter((F.col("head") == F.col("tail")) | (F.col("c1") == F.col("c2")))
    name = F.coalesce(F.col("c1"), F.col("head"))
    loops = inside.filter(F.col("c1").isNull()).select(F.col("head").alias("node"), F.col("head").alias("component"))
    return (comp.select("node", "component").union(inside.select("node", name.alias("component")))
            .union(loops.distinct()).union(rings))


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of size > 1: (node, component); a component is
    named by one of its nodes.

    Nodes without in- or out-edges go first, then chains become single edges, both as
    long as they shorten the graph. In what is left every node takes the largest id among
    the nodes that reach it (f) and
    among the nodes it reaches (b), both propagated in the same steps. A node
    with f == b == c is reached by c and reaches c, so it lies in c's
    component; two nodes of one component always share (f, b), so edges
    between different pairs are dropped and each round works on all classes
    at once. Each round resolves at least the component of every class's
    largest node. One Spark job per step; written steps bound lineage.
    """
    steps = _Steps()
    e = _trim(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct(), steps)
    taken = []
    while (cut := _chains(e, steps)) is not None:
        taken.append(cut[:2])
        e = _trim(cut[2], steps)
    found = []
    while True:
        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        state, n_nodes, _ = steps(nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b"),
                                               F.lit(True).alias("cf"), F.lit(True).alias("cb"),
                                               F.lit(True).alias("changed")))
        if n_nodes == 0:
            break
        both = e.select(F.col("src").alias("a"), F.col("dst").alias("t"), F.lit(True).alias("fwd")).union(
            e.select(F.col("dst").alias("a"), F.col("src").alias("t"), F.lit(False).alias("fwd")))
        while True:
            state, _, changed = steps(_label_step(state, both), "changed")
            if not changed:
                break
        state = state.select("node", "f", "b")
        comp = state.filter(F.col("f") == F.col("b")).select("node", F.col("f").alias("component"))
        sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
        part, _, _ = steps(comp.join(_big(sizes), "component", "left_semi").select("node", "component"))
        found.append(part)
        # keep edges inside one (f, b) class whose ends are both unresolved
        open_ = state.filter(F.col("f") != F.col("b"))
        rest = (e.join(_big(open_.select(F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1"))),
                       "src")
                .join(_big(open_.select(F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))),
                      "dst")
                .filter((F.col("f1") == F.col("f2")) & (F.col("b1") == F.col("b2")))
                .select("src", "dst"))
        e = _trim(rest, steps)
    node_type = edges.schema["src"].dataType.simpleString()
    out = edges.sparkSession.createDataFrame([], f"node {node_type}, component {node_type}")
    for f in found:
        out = out.union(f)
    for links, rings in reversed(taken):
        out = saved(_put_back(out, links, rings))
    return out


def circular_edges(edges: DataFrame) -> DataFrame:
    """G1: an edge u -> v is circular iff v reaches u: both ends in one
    strongly connected component, or a self-loop."""
    e = saved(edges.select("src", "dst").distinct())
    comp = components(e)
    tagged = (e.join(comp.withColumnRenamed("node", "src").withColumnRenamed("component", "c1"), "src", "left")
              .join(comp.withColumnRenamed("node", "dst").withColumnRenamed("component", "c2"), "dst", "left"))
    return (tagged.filter((F.col("src") == F.col("dst")) | (F.col("c1") == F.col("c2")))
            .select("src", "dst"))


def violations(circular_p: DataFrame, severity: str = "error") -> DataFrame:
    """One no-circular rule violation per circular edge."""
    return circular_p.select(*SNAP, F.lit("no-circular").alias("rule"), F.lit(severity).alias("severity"),
                             F.col("src_path").alias("from_path"), F.col("dst_path").alias("to_path"))


def cycle_metrics(modules: DataFrame, edges_p: DataFrame, circular_p: DataFrame,
                  violations: DataFrame | None = None) -> DataFrame:
    """A5: per snapshot modules, dependencies and cycle count (violations, or
    when there is none the number of directed circular edges)."""
    def counted(rows, name):
        return rows.groupBy(*SNAP).agg(F.count(F.lit(1)).alias(name))
    out = (counted(modules, "total_modules").join(counted(edges_p, "total_dependencies"), SNAP, "left")
           .join(counted(circular_p, "circular_edges"), SNAP, "left"))
    if violations is not None:
        out = out.join(counted(violations, "violations"), SNAP, "left")
    else:
        out = out.withColumn("violations", F.lit(0).cast("bigint"))
    out = out.fillna(0, subset=["total_dependencies", "circular_edges", "violations"])
    return out.withColumn("cycle_count", F.coalesce(F.nullif(F.col("violations"), F.lit(0)),
                                                    F.col("circular_edges")))


def cycle_counts_by_file(circular_p: DataFrame) -> DataFrame:
    """Each unordered circular pair of a snapshot once; both ends +1 (a self-loop +2)."""
    pairs = circular_p.select(*SNAP, F.least("src_path", "dst_path").alias("a"),
                              F.greatest("src_path", "dst_path").alias("b")).distinct()
    return (pairs.select(*SNAP, F.explode(F.array("a", "b")).alias("path"))
            .groupBy(*SNAP, "path").agg(F.count(F.lit(1)).alias("cycles")))


# ---- reachability (G7, C10) ------------------------------------------------------------
def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Every node reachable from ``starts(node)`` (the starts included).

    Reached sources are merged into one (a NULL ``src``). A node whose in-edges come from
    one node only is reached iff that node is, so it points at it, and pointer jumping
    finds the first ancestor with several sources (its root), a reached node, or none.
    A round settles all such nodes, takes what the reached set points at, and keeps
    only the edges between roots; it ends when none leads out of the reached set. Trees
    and chains cost the logarithm of their depth, rounds grow with the depth of the
    graph of the roots. Nodes with a root wait for it and are put back in reverse order.
    Every table that a later step needs is written to the shared folder.
    """
    s = saved(starts.select("node").filter(F.col("node").isNotNull()).distinct())
    start = s.withColumn("hot", F.lit(True))
    e = (edges.select("src", "dst").join(_big(s.withColumnRenamed("node", "dst")), "dst", "left_anti")
         .join(_big(start.withColumnRenamed("node", "src")), "src", "left")
         .select(F.when(~F.coalesce("hot", F.lit(False)), F.col("src")).alias("src"), "dst").distinct())
    steps, found, waiting = _Steps(), [], []
    while True:
        e, _, hot = steps(e.withColumn("hot", F.col("src").isNull()), "hot")
        if not hot:
            break
        # kind: 0 reached, 1 root (several sources), 2 unsettled, 3 never reached
        into = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.max("src").alias("up"),
                                    F.max("hot").alias("hot"))
        kind = F.when(F.col("hot"), 0).when(F.col("n") > 1, 1).otherwise(2)
        state, _, open_ = steps(into.select(F.col("dst").alias("node"), kind.alias("kind"),
                                            F.when(kind == 1, F.col("dst")).when(kind == 2, F.col("up")).alias("up"))
                                .withColumn("open", F.col("kind") == 2), "open")
        done, rest, left = [state.filter("kind < 2").drop("open")], state.filter("kind = 2").drop("open"), None
        while open_ and open_ != left:  # what stays open hangs on a ring and is never reached
            left = open_
            other = _all([*done, rest]).select(F.col("node").alias("up"), F.col("kind").alias("k2"), F.col("up").alias("up2"))
            # a step rewrites unsettled nodes only
            jumped, _, open_ = steps(rest.join(_big(other), "up").select("node", F.col("k2").alias("kind"), F.col("up2").alias("up"))
                                     .withColumn("open", F.col("kind") == 2), "open")
            done.append(jumped.filter("kind < 2").drop("open"))
            rest = jumped.filter("kind = 2").drop("open")
        state = _all(done)
        found.append(state.filter("kind = 0").select("node"))
        pending = state.filter("kind = 1")
        waiting.append(pending.filter(F.col("node") != F.col("up")).select("node", F.col("up").alias("root")))
        roots = pending.filter(F.col("node") == F.col("up")).select(F.col("node").alias("dst"))
        settled = state.select(F.col("node").alias("src"), F.col("up").alias("root"))
        e = (e.select("src", "dst").join(_big(roots), "dst", "left_semi").join(_big(settled), "src")
             .select(F.col("root").alias("src"), "dst")
             .filter(F.col("src").isNull() | (F.col("src") != F.col("dst"))).distinct())
    # a root of a round is settled in later rounds, so only what these found is looked up
    out = s.limit(0)
    for hits, w in zip(reversed(found), reversed(waiting)):
        late = saved(w.join(_big(out.withColumnRenamed("node", "root")), "root", "left_semi").select("node"))
        out = out.union(late).union(hits)
    return out.union(s)


def unused_files(modules: DataFrame, reached: DataFrame) -> DataFrame:
    """Modules not reachable from any entry."""
    return modules.join(reached.select("node"), "node", "left_anti")


# ---- rules (G8, G9) ----------------------------------------------------------------------
_PLAIN = re.compile(r"(?:[\w/@# -]|\\[^\w\s])*")


def _matches(path: Column, template: str, group: Column) -> Column:
    """Whether ``path`` matches a regex in which ``$1`` stands for the text ``group``.

    In a template that begins with ``^``, plain text and ``$1`` up to its last ``$1``, that
    part is a comparison of prefixes and what follows it one constant pattern. Only other
    templates need a pattern of their own for each row.
    """
    if "$1" not in template:
        return path.rlike(template)
    *before, tail = template.split("$1")
    plain = before[0].startswith("^") and all(map(_PLAIN.fullmatch, [before[0][1:], *before[1:]]))
    # an alternative or a quantifier right behind $1 reaches back into the prefix
    if plain and "|" not in re.sub(r"\([^()]*\)|\\.", "", tail) and tail[:1] not in ("?", "*", "+", "{"):
        texts = [re.sub(r"\\(.)", r"\1", t) for t in [before[0][1:], *before[1:]]]
        prefix = F.concat(*[x for t in texts for x in (F.lit(t), group)])
        rest = F.substr(path, F.length(prefix) + 1)
        return path.startswith(prefix) & (rest.rlike(f"^{tail}") if tail else F.lit(True))
    literal = F.regexp_replace(group, r"([^\p{L}\p{N}_])", r"\\$1")
    return F.regexp(path, F.replace(F.lit(template), F.lit("$1"), literal))


def rule_set_violations(edges_p: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every rule that an edge breaks: (snapshot, rule, severity, src_path, dst_path).

    A rule forbids edges that meet all the conditions it states: the source matches
    ``from_path``, the target matches ``to_path`` and not ``to_path_not`` (``$1`` in them
    is the source's first group, taken literally), and for ``circular`` the column of that name has
    the asked value (NULL counts as false). All rules are tested in one pass over the edges
    without a shuffle; ignored rules are left out. A NULL path breaks no rule.
    """
    broken = []
    for r in rules:
        if r.severity == "ignore":
            continue
        named = r.from_path and "$1" in (r.to_path or "") + (r.to_path_not or "")
        group = F.regexp_extract("src_path", r.from_path, 1) if named else F.lit("")
        hit = F.col("src_path").isNotNull() & F.col("dst_path").isNotNull()
        if r.from_path:
            hit = hit & F.col("src_path").rlike(r.from_path)
        if r.to_path:
            hit = hit & _matches(F.col("dst_path"), r.to_path, group)
        if r.to_path_not:
            hit = hit & ~_matches(F.col("dst_path"), r.to_path_not, group)
        if r.circular is not None:
            hit = hit & (F.coalesce(F.col("circular"), F.lit(False)) == F.lit(r.circular))
        broken.append(F.when(hit, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))))
    none = F.lit(None).cast("struct<rule:string,severity:string>")
    return (edges_p.withColumn("broken", F.explode(F.array_compact(F.array(none, *broken))))
            .select(*SNAP, "broken.rule", "broken.severity", "src_path", "dst_path"))


def rule_summary(snapshots: DataFrame, broken: DataFrame) -> DataFrame:
    """Per snapshot of ``snapshots`` the number of broken rules of each severity, and whether the
    snapshot passes (no error)."""
    counts = broken.groupBy(*SNAP).agg(*[F.count_if(F.col("severity") == x).alias(x) for x in SEVERITIES])
    return (snapshots.select(*SNAP).distinct().join(counts, SNAP, "left").fillna(0, subset=list(SEVERITIES))
            .withColumn("passes", F.col("error") == 0))


def rule_violations(edges_p: DataFrame, name: str, from_regex: str, to_not_template: str) -> DataFrame:
    """G8 with a single rule: edges whose source matches ``from_regex`` and whose target does not
    match ``to_not_template`` with ``$1`` replaced by the source's first group, taken
    literally."""
    return (rule_set_violations(edges_p, [Rule(name, from_path=from_regex, to_path_not=to_not_template)])
            .drop("severity"))


def more_unstable_violations(edges_p: DataFrame, by_file: DataFrame) -> DataFrame:
    """An edge into a module less stable than its source."""
    i = by_file.select("node", "instability")
    return (edges_p.join(i.withColumnRenamed("node", "src").withColumnRenamed("instability", "src_i"), "src")
            .join(i.withColumnRenamed("node", "dst").withColumnRenamed("instability", "dst_i"), "dst")
            .filter(F.col("dst_i") > F.col("src_i"))
            .select(*SNAP, "src_path", "dst_path", "src_i", "dst_i"))


# ---- many snapshots at once ------------------------------------------------------------------
def index_nodes(edges_by_path: DataFrame, keys=("repo", "snapshot_id")) -> tuple[DataFrame, DataFrame]:
    """Give every (snapshot, path) a unique BIGINT id so the graphs of many
    repositories and snapshots form one disjoint union that the iterative
    operators process in the same steps.

    ``edges_by_path``: (*keys, src_path, dst_path). Returns (edges(src, dst),
    nodes(node, *keys, path)). Ids come from ``monotonically_increasing_id``
    (unique without a shuffle, no hash collisions); the node table is
    checkpointed because such ids are not stable if recomputed.
    """
    k = list(keys)
    paths = (edges_by_path.select(*k, F.col("src_path").alias("path"))
             .union(edges_by_path.select(*k, F.col("dst_path").alias("path"))).distinct())
    nodes = saved(paths.withColumn("node", F.monotonically_increasing_id()))
    e = (edges_by_path
         .join(nodes.withColumnRenamed("path", "src_path").withColumnRenamed("node", "src"), [*k, "src_path"])
         .join(nodes.withColumnRenamed("path", "dst_path").withColumnRenamed("node", "dst"), [*k, "dst_path"])
         .select("src", "dst"))
    return e, nodes
