"""Clone detection: maximal repeats of normalised lines within a snapshot.

Two places are a clone if they hold the same run of lines and neither the lines before
nor the lines behind it are equal. Places that share their first lines form the tree of
their common beginnings, whose inner nodes are the maximal repeats; it is built by
doubling, in steps that only compare numbers:

1. per file, one array of normalised lines with their original line numbers and token
   counts (mode: strict / mild / weak);
2. every window of ``min_lines`` lines is a place. Places with one window form a group;
   groups of one place, or whose places all have the same line before, go (the run
   that begins one line earlier has them): what stays of a block's copies is where they begin;
3. lengths are refined from the largest power of two down. The places of a group that also share
   the next 2^j lines form a longer group, and leave their smallest place behind to stand
   for them. In the end the places in a group differ in their next line;
4. a group's smallest place is linked to each other one that has another line before it.
   A block copied m times gives m-1 clones, places that differ earlier are linked in the
   shorter group, so rows grow with the lines and no holder of a block is left out;
5. both texts of a clone are compared by SHA-256, runs below ``min_tokens`` are dropped, and of
   runs that lie in another one in the same second file the outer one stays.

Groups are counted by partial sums and joined back, so a window that a third of all files
hold is one inner-join side that AQE splits; there is no window over a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codehealth.params import CloneParams
from codehealth.session import saved

SNAP = ["repo", "snapshot_id"]
# ---- fixed values ------------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}_]+|[^ \t\n\f\r\p{L}\p{N}_]"
TRIM = r"^[ \t\r]+|[ \t\r]+$"
COMMENT = r"^(//|#|/\*|\*|--)"
# --------------------------------------------------------------------------------------


def normalised_lines(files: DataFrame, mode: str = "mild", tokens: bool = True) -> DataFrame:
    """(…, path, arr) with arr = array<struct<ln, t, tok>> of kept lines; tokens are counted (tok) on demand.

    strict: raw lines (blank ones too); mild: trimmed, blanks dropped;
    weak: as mild, comment lines dropped as well.
    """
    lines = F.split(F.col("content"), "\n", -1)
    if mode == "strict":
        items = F.transform(lines, lambda x, i: F.struct((i + 1).alias("ln"), x.alias("t")))
    else:
        items = F.transform(lines, lambda x, i: F.struct((i + 1).alias("ln"),
                                                          F.regexp_replace(x, TRIM, "").alias("t")))
        if mode == "mild":
            items = F.filter(items, lambda s: s["t"] != "")
        elif mode == "weak":
            items = F.filter(items, lambda s: (s["t"] != "") & ~s["t"].rlike(COMMENT))
        else:
            raise ValueError(f"unknown mode {mode!r}")
    if not tokens:
        return files.select(*SNAP, "path", items.alias("arr"))
    with_tok = F.transform(items, lambda s: F.struct(s["ln"].alias("ln"), s["t"].alias("t"),
                                                     F.regexp_count(s["t"], F.lit(TOKEN)).alias("tok")))
    return files.select(*SNAP, "path", with_tok.alias("arr"))


def _line_numbers(ids: DataFrame, levels: int) -> DataFrame:
    """(repo, snapshot_id, path, at, ids): for each line, hashes of the 1, 2, 4 ... lines from there, null beyond the end."""
    out = ids.withColumnRenamed("ids", "l0")
    for j in range(1, levels):
        half, before = 1 << (j - 1), F.col(f"l{j - 1}")
        places = F.size(before) - half
        out = out.withColumn(f"l{j}", F.when(places > 0, F.transform(
            F.sequence(F.lit(1), places), lambda i: F.xxhash64(F.element_at(before, i), F.element_at(before, i + half)))).otherwise(
            F.array().cast("array<bigint>")))
    rows = F.transform("l0", lambda x, i: F.struct((i + 1).alias("at"), F.array(*[F.get(f"l{j}", i) for j in range(levels)]).alias("ids")))
    return out.select(*SNAP, "path", F.explode(rows).alias("x")).select(*SNAP, "path", "x.*")


def _starts(ids: DataFrame, k: int) -> DataFrame:
    """Places (with the number of lines from there on) in groups of equal windows whose places have different lines before them."""
    n = F.size("ids")
    window = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.slice("ids", i, k)).alias("g"), F.get("ids", i - 2).alias("left"), (n - i + 1).alias("rest")))
    # guard n >= k: a descending sequence would produce bogus windows
    places = ids.select(*SNAP, "path", F.explode(F.when(n >= k, window)).alias("x")).select(*SNAP, "path", "x.*")
    places = places.withColumn("left", F.when(F.col("pos") > 1, F.col("left")))
    groups = places.groupBy(*SNAP, "g").agg(F.count("*").alias("n"), F.count("left").alias("lefts"), F.min("left").alias("lo"), F.max("left").alias("hi"))
    groups = groups.filter((F.col("n") > 1) & ((F.col("lefts") < F.col("n")) | (F.col("lo") != F.col("hi"))))
    return places.join(groups.select(*SNAP, "g"), [*SNAP, "g"])


def repeats(norm: DataFrame, k: int) -> DataFrame:
    """The tree's inner nodes: (repo, snapshot_id, g, len, path, pos, left, copies), one row for each place that stands for a
    branch of the node ``g``; ``copies`` places lie in the branch."""
    # one number a line, written once: places, their groups and the runs behind them all start from it
    ids = saved(norm.select(*SNAP, "path", F.transform("arr", lambda s: F.xxhash64(s["t"])).alias("ids")))
    units = saved(_starts(ids, k))
    most = units.agg(F.max("rest")).first()[0]
    units = units.select(*SNAP, "g", F.lit(k).alias("len"), "path", "pos", "left", F.lit(1).cast("bigint").alias("copies"))
    levels = max(0, most - k).bit_length() if most else 0
    if not levels:
        return units
    names = [*SNAP, "g", "len", "path", "pos", "left", "copies"]
    some = ids.join(units.select(*SNAP, "path").distinct(), [*SNAP, "path"], "left_semi")
    lines = saved(_line_numbers(some, levels).repartition(*SNAP, "path", "at"))
    for j in reversed(range(levels)):
        on = lines.select(*SNAP, "path", "at", F.col("ids")[j].alias("next"))
        placed = saved(units.withColumn("at", F.col("pos") + F.col("len")).join(on, [*SNAP, "path", "at"], "left").drop("at"))
        key = [*SNAP, "g", "len", "next"]
        more = placed.filter("next is not null").groupBy(*key).agg(
            F.count("*").alias("n"), F.min(F.struct("path", "pos", "left")).alias("first"), F.sum("copies").alias("all")).filter("n > 1")
        both = placed.join(more, key, "left")
        longer = F.col("n").isNotNull()
        units = both.select(*SNAP, F.when(longer, F.xxhash64("g", "next")).otherwise(F.col("g")).alias("g"),
                            (F.col("len") + F.when(longer, 1 << j).otherwise(0)).alias("len"), "path", "pos", "left", "copies").unionByName(
            more.select(*SNAP, "g", "len", "first.*", F.col("all").alias("copies"))).select(*names)
    return units


def _details(norm: DataFrame, runs: DataFrame) -> DataFrame:
    """Line numbers, tokens and text digest of runs (repo, snapshot_id, path, pos, len)."""
    wanted = runs.distinct().groupBy(*SNAP, "path").agg(F.collect_list(F.struct("pos", "len")).alias("runs"))

    def told(r):
        part = F.slice("arr", r["pos"], r["len"])
        return F.struct(r["pos"].alias("pos"), r["len"].alias("len"), F.element_at(part, 1)["ln"].alias("start"), F.element_at(part, -1)["ln"].alias("end"),
                        F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x["tok"]).alias("tokens"),
                        F.sha2(F.array_join(F.transform(part, lambda x: x["t"]), "\n"), 256).alias("digest"))
    return wanted.join(norm, [*SNAP, "path"]).select(*SNAP, "path", F.explode(F.transform("runs", told)).alias("x")).select(*SNAP, "path", "x.*")


def _clones(norm: DataFrame, k: int, plain: DataFrame | None = None) -> DataFrame:
    """The links of every node: its smallest place to each branch with another line before it, as runs of equal text.
    ``plain`` has the same lines without their tokens, which the tree doesn't need."""
    branches = saved(repeats(norm if plain is None else plain, k))
    key = [*SNAP, "g", "len"]
    nodes = branches.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("path", "pos", "left")).alias("first"), F.sum("copies").alias("places")).filter("n > 1")
    both = branches.join(nodes, key).filter(
        ((F.col("path") != F.col("first.path")) | (F.col("pos") != F.col("first.pos")))
        & (F.col("left").isNull() | F.col("first.left").isNull() | (F.col("left") != F.col("first.left"))))
    links = saved(both.select(*SNAP, "len", F.col("first.path").alias("first_file"), F.col("first.pos").alias("first_pos"),
                              F.col("path").alias("second_file"), F.col("pos").alias("second_pos"), F.col("places")))
    # written, as both sides of a link look their runs up in it
    told = saved(_details(norm, links.select(*SNAP, F.col("first_file").alias("path"), F.col("first_pos").alias("pos"), "len").union(
        links.select(*SNAP, "second_file", "second_pos", "len"))))

    def side(name):
        return told.select(*SNAP, F.col("path").alias(f"{name}_file"), F.col("pos").alias(f"{name}_pos"), "len", F.col("start").alias(f"{name}_start"),
                           F.col("end").alias(f"{name}_end"), F.col("tokens").alias(f"{name}_tokens"), F.col("digest").alias(f"{name}_digest"))
    out = links.join(side("first"), [*SNAP, "first_file", "first_pos", "len"]).join(side("second"), [*SNAP, "second_file", "second_pos", "len"])
    return out.filter("first_digest = second_digest").select(
        *SNAP, "first_file", "second_file", "first_pos", F.col("second_pos").alias("start_pos"), (F.col("second_pos") + F.col("len") - 1).alias("end_pos"),
        "first_start", "first_end", "second_start", "second_end", F.col("first_tokens").alias("tokens"), "places", "first_digest")


def _chosen(files: DataFrame, params: CloneParams) -> DataFrame:
    """Formats, ignored globs and text, largest files."""
    f = files
    n_lines = F.size(F.split(F.col("content"), "\n", -1))
    if params.formats:
        from codehealth.functions.paths import extension
        f = f.filter(extension(F.col("path")).isin(list(params.formats)))
    if params.max_lines:
        f = f.filter(n_lines <= params.max_lines)
    if params.max_size:
        f = f.filter(F.octet_length("content") <= params.max_size)
    if params.ignore:
        from codehealth.functions.paths import exclude_globs
        f = exclude_globs(f, "path", params.ignore)
    if params.ignore_pattern:
        # matching text is ignored (e.g. license headers); the file's other lines stay
        f = f.withColumn("content", F.regexp_replace("content", params.ignore_pattern, ""))
    return f


def clone_classes(files: DataFrame, params: CloneParams = CloneParams()) -> DataFrame:
    """One row for each maximal repeat, at its smallest place, with the number of places that hold it.

    Columns: repo, snapshot_id, first_file, first_start, first_end, norm_lines, tokens, places. Its members
    are the second places of ``clone_pairs`` that name the class's first place, and what is linked to these by longer runs.
    """
    chosen = _chosen(files, params)
    runs = _clones(normalised_lines(chosen, params.mode), params.min_lines, normalised_lines(chosen, params.mode, tokens=False)).filter(F.col("tokens") >= params.min_tokens)
    return runs.select(*SNAP, "first_file", F.col("first_start").cast("bigint").alias("first_start"), F.col("first_end").cast("bigint").alias("first_end"),
                       (F.col("end_pos") - F.col("start_pos") + 1).cast("bigint").alias("norm_lines"), "tokens", "places").distinct()


def clone_pairs(files: DataFrame, params: CloneParams = CloneParams()) -> DataFrame:
    """C5 (+ C7 skip-local, P3 formats / max-lines / max-size filters): one row per clone.

    Columns: repo, snapshot_id, first_file, first_start, first_end,
    second_file, second_start, second_end, lines, norm_lines, tokens.
    """
    chosen = _chosen(files, params)
    runs = _clones(normalised_lines(chosen, params.mode), params.min_lines, normalised_lines(chosen, params.mode, tokens=False)).filter(F.col("tokens") >= params.min_tokens)
    # a second place is listed with its longest match, the smallest first place among equals
    longer = (Window.partitionBy(*SNAP, "second_file")
              .orderBy("start_pos", F.desc("end_pos"), "first_file", "first_start")
              .rowsBetween(Window.unboundedPreceding, -1))
    reach = F.max("end_pos").over(longer)
    runs = runs.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("reach") < F.col("end_pos")))
    out = runs.select(*SNAP, "first_file", F.col("first_start").cast("bigint").alias("first_start"),
                      F.col("first_end").cast("bigint").alias("first_end"), "second_file",
                      F.col("second_start").cast("bigint").alias("second_start"),
                      F.col("second_end").cast("bigint").alias("second_end"),
                      (F.col("second_end") - F.col("second_start") + 1).cast("bigint").alias("lines"),
                      (F.col("end_pos") - F.col("start_pos") + 1).cast("bigint").alias("norm_lines"),
                      F.col("tokens").cast("bigint").alias("tokens"))
    if params.skip_local:
        out = out.filter(_parent("first_file") != _parent("second_file"))
    return out


def _parent(c):
    return F.regexp_replace(F.col(c), "/[^/]*$", "")


def _covered(clones: DataFrame) -> DataFrame:
    """The disjoint line spans (repo, snapshot_id, path, start, end) of second files that clones cover."""
    spans = clones.select(*SNAP, F.col("second_file").alias("path"), F.col("second_start").alias("start"),
                          F.col("second_end").alias("end")).distinct()
    by_start = Window.partitionBy(*SNAP, "path").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    parts = parts.withColumn("part", F.sum("opens").over(by_start))
    return (parts.groupBy(*SNAP, "path", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .drop("part"))


def duplication_totals(clones: DataFrame, files: DataFrame, mode: str = "mild") -> DataFrame:
    """Clones, duplicated-lines and duplicated-tokens percent (two
    decimals, integer arithmetic) and total lines, per snapshot. A line of a second
    file counts once, however many clones cover it."""
    norm = normalised_lines(files, mode)
    base = norm.select(*SNAP, F.aggregate("arr", F.lit(0), lambda a, s: a + s["tok"]).alias("tok"))
    totals = files.select(*SNAP, F.size(F.split(F.col("content"), "\n", -1)).alias("lines")).groupBy(*SNAP).agg(
        F.sum("lines").alias("total_lines"))
    tok_tot = base.groupBy(*SNAP).agg(F.sum("tok").alias("total_tokens"))
    c = clones.groupBy(*SNAP).agg(F.count(F.lit(1)).alias("clones"))
    covered = _covered(clones).groupBy(*SNAP, "path").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    inside = norm.join(covered, [*SNAP, "path"]).select(
        *SNAP, F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"] + 1).alias("lines"),
        F.aggregate("arr", F.lit(0), lambda a, s: a + F.when(
            F.exists("spans", lambda x: s["ln"].between(x["start"], x["end"])), s["tok"]).otherwise(0)).alias("tok"))
    dup = inside.groupBy(*SNAP).agg(F.sum("lines").alias("dup_lines"), F.sum("tok").alias("dup_tokens"))
    j = (totals.join(tok_tot, SNAP).join(c, SNAP, "left").join(dup, SNAP, "left")
         .fillna(0, subset=["clones", "dup_lines", "dup_tokens"]))

    def pct(num, den):
        return F.expr(f"(10000 * {num} + div({den}, 2)) div greatest({den}, 1)") / F.lit(100.0)
    return j.select(*SNAP, F.col("clones").cast("bigint").alias("clones"),
                    pct("dup_lines", "total_lines").alias("duplicated_lines_percent"),
                    pct("dup_tokens", "total_tokens").alias("duplicated_tokens_percent"),
                    F.col("total_lines").cast("bigint").alias("total_lines"))


def threshold_gate(totals: DataFrame, threshold: float) -> DataFrame:
    """Duplication above the threshold fails the check."""
    return totals.withColumn("exceeds_threshold", F.col("duplicated_lines_percent") > F.lit(float(threshold)))


def clone_counts_by_file(clones: DataFrame) -> DataFrame:
    """Every clone counts once on each side (a self-clone twice)."""
    return (clones.select(*SNAP, F.explode(F.array("first_file", "second_file")).alias("path"))
            .groupBy(*SNAP, "path").agg(F.count(F.lit(1)).alias("duplication")))


def clones_by_file(clones: DataFrame) -> DataFrame:
    """Every clone oriented from each file it touches (self / other);
    when both ends are the same file the clone is listed once."""
    both = F.array(
        F.struct(F.lit(1).alias("o"), F.col("first_file").alias("path"), F.col("first_start").alias("self_start"),
                 F.col("first_end").alias("self_end"), F.col("second_file").alias("other_path"),
                 F.col("second_start").alias("other_start"), F.col("second_end").alias("other_end")),
        F.struct(F.lit(2).alias("o"), F.col("second_file").alias("path"), F.col("second_start").alias("self_start"),
                 F.col("second_end").alias("self_end"), F.col("first_file").alias("other_path"),
                 F.col("first_start").alias("other_start"), F.col("first_end").alias("other_end")))
    x = clones.select(*SNAP, "lines", F.explode(both).alias("c")).select(*SNAP, "lines", "c.*")
    return x.filter(~((F.col("o") == 2) & (F.col("path") == F.col("other_path")))).drop("o")
