"""Adapters from the driver's parquet tables to the canonical tables.

Every operator runs on real rows that grow with the data:

============================  =================================================
canonical table               built from
============================  =================================================
``source_files``              ``documents`` (one file per document)
``file_history``              ``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region``
                              (one monthly snapshot per order month)
``check_results``             ``events`` (one daily snapshot per event day)
``modules`` / ``dep_edges``   parts and order sequences of ``lineitem``, one snapshot
                              per order month
``entries``                   modules with ``p_size <= 5``
``exports`` / ``imports``     ``lineitem`` (supplier files export part symbols)
``used`` / ``declared``       packages ordered / shipped in a month
``commits`` / ``touches``     ``orders`` / ``lineitem``
============================  =================================================

Joins are ordered so that aggregation happens before the wide joins: line
items are reduced per order before meeting ``orders``, and per
(customer, month) before meeting ``customer``. ``nation`` and ``region`` have a
fixed size by the TPC-H specification (25 and 5 rows) and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# ---- fixed values of the adapters -------------------------------------------
HISTORY_REPO = "tpch"
EVENTS_REPO = "events"
SOURCE_ROOT = "src"
# events.event_type -> check status (error fails, view is skipped, click warns)
EVENT_STATUS = {"error": "fail", "view": "skip", "click": "warn"}
# events.event_type -> metric kind carried by the check
EVENT_METRIC_KIND = {"purchase": "stats-overview", "signup": "unused",
                     "click": "duplicates", "error": "cycles"}
# a graph node is (month number, part key): month * NODE_STEP + key
NODE_STEP = 1 << 44
ENTRY_MAX_SIZE = 5
IMPORT_MAX_QUANTITY = 10
DECLARED_MIN_SIZE = 26
# part type words -> unused-export kind (first word of p_type)
EXPORT_KIND_BY_TYPE = {"STANDARD": "exports", "SMALL": "types", "MEDIUM": "classMembers",
                       "LARGE": "nsExports", "ECONOMY": "enumMembers", "PROMO": "nsTypes"}
ANNOTATED_LANGUAGES = ("ts", "py", "sql", "txt")  # by doc_id
# -----------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- corpus -----------------------------------------------------------------
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, path, language, content) from ``documents``."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("repo"),
        F.lit("corpus").alias("snapshot_id"),
        F.concat(F.lit(SOURCE_ROOT + "/"), F.col("source"), F.lit("/"), F.col("lang"),
                 F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )


def annotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as source files of one repository per language, a folder per source, with a
    remark and a blank line before every third line, at places that differ by document: for
    what tells blank and comment lines from code, and clones across folders."""
    docs = read(spark, sf_dir, "documents")
    remark = lambda i: F.when(i % 2 == 0, F.lit("// note\n\n")).otherwise(
        F.when(F.col("doc_id") % 8 < 4, F.lit("/* block\n still */\n\n")).otherwise(F.lit("// note\n\n")))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(
        F.when((i + F.col("doc_id")) % 3 == 0, remark(i)).otherwise(F.lit("")), x))
    ending = F.element_at(F.array(*[F.lit(e) for e in ANNOTATED_LANGUAGES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(F.col("lang").alias("repo"), F.lit("annotated").alias("snapshot_id"),
                       F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"),
                       ending.alias("language"), F.array_join(lines, "\n").alias("content"))


# Lines put between the lines of a document, by turns: markers in strings, a block comment
# opened after code and one that code follows, comments only, a string over several lines.
LEXED_TS = ('let s = "/* no // \\" yet";', "run(); /* opens\n\n it's in */ done();", "/* a */ /* b */ // c", "t = `\n// in\n`;")
LEXED_PY = ("s = '# no \\' yet'", 'x = """\n# in\n"""  # out', "  # it's a remark", "")


def lexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as TypeScript (even ids) and Python files with a piece of ``LEXED_TS`` or
    ``LEXED_PY`` before every line; quotes, grave accents, number signs, slashes and backslashes of the
    documents themselves are blanked out."""
    docs = read(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0

    def piece(i):
        turn = ((i + F.col("doc_id")) % 4 + 1).cast("int")
        return F.when(even, F.element_at(F.array(*map(F.lit, LEXED_TS)), turn)).otherwise(
            F.element_at(F.array(*map(F.lit, LEXED_PY)), turn))
    lines = F.transform(F.split(F.translate("text", "\"'`#/\\", "      "), "\n", -1),
                        lambda x, i: F.concat(piece(i), F.lit("\n"), x))
    ending = F.when(even, F.lit("ts")).otherwise(F.lit("py"))
    return docs.select(F.col("lang").alias("repo"), F.lit("lexed").alias("snapshot_id"),
                       F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"),
                       ending.alias("language"), F.array_join(lines, "\n").alias("content"))


# ---- monthly file history ---------------------------------------------------
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (snapshot month, file) stats and issue counts.

    Columns: repo, snapshot_id (yyyy-MM), ts, path, lines, code, complexity,
    unused, duplication, cycles.
    """
    li = read(spark, sf_dir, "lineitem")
    per_order = (li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_linestatus") == "F").alias("code"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("complexity"),
        F.count_if(F.col("l_returnflag") == "R").alias("unused"),
        F.count_if(F.col("l_returnflag") == "A").alias("duplication"),
        F.count_if(F.col("l_discount") >= 0.09).alias("cycles"),
    ))
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.date_format("o_orderdate", "yyyy-MM").alias("snapshot_id"))
    per_cust_month = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
                      .groupBy("o_custkey", "snapshot_id")
                      .agg(*[F.sum(c).alias(c) for c in
                             ("lines", "code", "complexity", "unused", "duplication", "cycles")]))
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))
    out = (per_cust_month.join(cust, per_cust_month.o_custkey == cust.c_custkey)
           .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    return out.select(
        F.lit(HISTORY_REPO).alias("repo"),
        "snapshot_id",
        F.to_timestamp(F.concat(F.col("snapshot_id"), F.lit("-01 00:00:00"))).alias("ts"),
        F.concat(F.lit(SOURCE_ROOT + "/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit("/"),
                 F.col("c_custkey").cast("string")).alias("path"),
        "lines", "code", "complexity", "unused", "duplication", "cycles",
    )


def snapshot_metrics_from_tree(tree: DataFrame) -> DataFrame:
    """The same per-snapshot metrics read off the root node of the roll-up
    (its sums are the snapshot totals), so no second pass over the history."""
    root = tree.filter(F.col("path") == SOURCE_ROOT)
    out = root.select(
        "repo", "snapshot_id",
        F.to_timestamp(F.concat(F.col("snapshot_id"), F.lit("-01 00:00:00"))).alias("ts"),
        F.col("files").alias("total_files"), F.col("lines").alias("total_lines"),
        F.col("code").alias("total_code"), F.col("complexity").alias("total_complexity"),
        F.col("unused").alias("total_issues"), F.col("duplication").alias("duplicated_lines"),
        F.col("cycles").alias("cycle_count"))
    pct_x100 = F.expr("(10000 * duplicated_lines + div(total_lines, 2)) div greatest(total_lines, 1)")
    return out.withColumn("duplicated_lines_percent", pct_x100 / F.lit(100.0))


def snapshot_metrics(history: DataFrame) -> DataFrame:
    """Per-snapshot metric values of the four metric kinds.

    stats-overview totals, unused total issues, duplicated-lines percent (two
    decimals, computed in integer arithmetic) and cycle count.
    """
    agg = history.groupBy("repo", "snapshot_id", "ts").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("lines").alias("total_lines"),
        F.sum("code").alias("total_code"),
        F.sum("complexity").alias("total_complexity"),
        F.sum("unused").alias("total_issues"),
        F.sum("duplication").alias("duplicated_lines"),
        F.sum("cycles").alias("cycle_count"),
    )
    pct_x100 = F.expr("(10000 * duplicated_lines + div(total_lines, 2)) div greatest(total_lines, 1)")
    return agg.withColumn("duplicated_lines_percent", pct_x100 / F.lit(100.0))


# ---- daily check results ----------------------------------------------------
def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, ts_raw, check_idx, name, status, duration_ms, kind, value)."""
    ev = read(spark, sf_dir, "events")
    status = F.lit("pass")
    for event, st in reversed(list(EVENT_STATUS.items())):
        status = F.when(F.col("event_type") == event, F.lit(st)).otherwise(status)
    kind = F.lit(None).cast("string")
    for event, k in reversed(list(EVENT_METRIC_KIND.items())):
        kind = F.when(F.col("event_type") == event, F.lit(k)).otherwise(kind)
    return ev.select(
        F.lit(EVENTS_REPO).alias("repo"),
        F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"),
        "ts",
        F.col("event_id").alias("check_idx"),
        F.col("event_type").alias("name"),
        status.alias("status"),
        F.floor(F.col("value") * 1000 + 0.5).cast("bigint").alias("duration_ms"),
        kind.alias("kind"),
        F.col("user_id").alias("count_value"),
        F.col("value").alias("percent_value"),
        F.col("props").alias("output"),
    )


# ---- dependency graph -------------------------------------------------------
def module_path(brand: str, key: str):
    return F.concat(F.lit(SOURCE_ROOT + "/"), F.col(brand), F.lit("/"), F.col(key).cast("string"))


def _monthly(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line items with the snapshot (month) of their order and the next part of it. Nine canonical tables
    start from them, so they are joined once and written in the narrow form that all of these read."""
    from codehealth.plans.materialize import materialized

    def build():
        li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                    "l_returnflag", "l_quantity")
        # the month is named once for an order, not for each of its line items
        o = read(spark, sf_dir, "orders").select(
            "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("snapshot_id"),
            (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("month_no"))
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            "snapshot_id", "month_no", F.lead("l_partkey").over(w).alias("next_part"), "l_partkey", "l_suppkey",
            "l_returnflag", "l_quantity")
    return materialized(spark, f"monthly:{sf_dir}", build).select(*columns)


def _node(part: str):
    return F.col("month_no") * F.lit(NODE_STEP) + F.col(part)


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, node BIGINT, path STRING, size INT): the parts ordered in a month."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    li = _monthly(spark, sf_dir, "month_no", "l_partkey")
    # dealt out by part first: these partitions serve both joins and the distinct
    li = li.join(p.select("p_partkey"), li.l_partkey == p.p_partkey, "left_semi").distinct()
    month = F.make_date(F.expr("int((month_no - 1) div 12)"), F.expr("int((month_no - 1) % 12 + 1)"), F.lit(1))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.lit(HISTORY_REPO).alias("repo"), F.date_format(month, "yyyy-MM").alias("snapshot_id"),
        _node("p_partkey").alias("node"), module_path("p_brand", "p_partkey").alias("path"), F.col("p_size").alias("size"))


def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst) node edges: a part imports the next part of its order."""
    nxt = _monthly(spark, sf_dir, "month_no", "l_partkey", "next_part").filter(F.col("next_part").isNotNull())
    return nxt.select(_node("l_partkey").alias("src"), _node("next_part").alias("dst")).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): the modules of the small parts. Line items of other parts go before the rest is made distinct."""
    p = read(spark, sf_dir, "part").filter(F.col("p_size") <= ENTRY_MAX_SIZE).select("p_partkey")
    li = _monthly(spark, sf_dir, "month_no", "l_partkey")
    small = li.join(p, li.l_partkey == p.p_partkey, "left_semi").distinct()
    return small.join(p, small.l_partkey == p.p_partkey).select(_node("p_partkey").alias("node"))


# ---- symbols and packages ----------------------------------------------------
def _supplier_file():
    return F.concat(F.lit(SOURCE_ROOT + "/supp/"), F.col("l_suppkey").cast("string")).alias("file")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (repo, snapshot_id, file, symbol, kind) export declaration, repeats kept.

    A supplier file exports the symbols of the parts it ships; the symbol kind
    comes from the first word of the part type.
    """
    li = _monthly(spark, sf_dir, "snapshot_id", "l_suppkey", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    kind = F.lit("exports")
    for word, k in reversed(list(EXPORT_KIND_BY_TYPE.items())):
        kind = F.when(F.substring_index(F.col("p_type"), " ", 1) == word, F.lit(k)).otherwise(kind)
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.lit(HISTORY_REPO).alias("repo"), "snapshot_id", _supplier_file(),
                    F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"),
                    kind.alias("kind")))


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, file, symbol) that somebody imports: returned items of small quantity."""
    li = _monthly(spark, sf_dir, "snapshot_id", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    return (li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= IMPORT_MAX_QUANTITY))
            .select("snapshot_id", "l_suppkey", "l_partkey").distinct()
            .select(F.lit(HISTORY_REPO).alias("repo"), "snapshot_id", _supplier_file(),
                    F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol")))


def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, file): supplier files whose exports are public, those with a part of size 1."""
    li = _monthly(spark, sf_dir, "snapshot_id", "l_suppkey", "l_partkey")
    p = read(spark, sf_dir, "part").filter(F.col("p_size") == 1).select("p_partkey")
    return (li.join(p, li.l_partkey == p.p_partkey, "left_semi").select("snapshot_id", "l_suppkey").distinct()
            .select(F.lit(HISTORY_REPO).alias("repo"), "snapshot_id", _supplier_file()))


def _package(key: str):
    return F.concat(F.lit("pkg-"), F.col(key).cast("string")).alias("package")


def declared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, package, kind): a month's manifest lists the larger parts shipped in it."""
    from codehealth.plans.materialize import materialized

    def build():
        li = read(spark, sf_dir, "lineitem").select("l_partkey", F.trunc("l_shipdate", "MM").alias("month"))
        p = read(spark, sf_dir, "part").filter(F.col("p_size") >= DECLARED_MIN_SIZE).select("p_partkey", "p_size")
        li = li.join(p.select("p_partkey"), li.l_partkey == p.p_partkey, "left_semi").distinct()
        return (li.join(p, li.l_partkey == p.p_partkey)
                .select(F.lit(HISTORY_REPO).alias("repo"), F.date_format("month", "yyyy-MM").alias("snapshot_id"), _package("p_partkey"),
                        F.when(F.col("p_size") >= 45, F.lit("devDependencies"))
                        .otherwise(F.lit("dependencies")).alias("kind")))
    # both differences of packages read it
    return materialized(spark, f"declared:{sf_dir}", build)


def used_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, package, file): every line item uses its part's package."""
    li = _monthly(spark, sf_dir, "snapshot_id", "l_partkey", "l_suppkey")
    # the partitions of the distinct serve the joins on packages as well
    return (li.select(F.lit(HISTORY_REPO).alias("repo"), "snapshot_id", _package("l_partkey"), _supplier_file())
            .repartition("snapshot_id", "package").distinct())


def workspaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as files of one repository whose folders are regions and nations: used(file, package),
    declared(manifest, package, kind), manifests(folder). The root, every region and every second
    nation hold a manifest; a file uses the parts its supplier ships."""
    snap = [F.lit("workspaces").alias("repo"), F.lit("all").alias("snapshot_id")]
    region = F.concat(F.lit("packages/r"), F.col("n_regionkey").cast("string"))
    nation = read(spark, sf_dir, "nation").select(
        "n_nationkey", region.alias("r"), F.concat(region, F.lit("/n"), F.col("n_nationkey").cast("string")).alias("n"))
    even = nation.filter(F.col("n_nationkey") % 2 == 0)
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    ending = F.when(F.col("s_suppkey") % 7 == 0, F.lit(".test.ts")).otherwise(F.lit(".ts"))
    used = (li.join(supplier, li.l_suppkey == supplier.s_suppkey)
            .join(F.broadcast(nation), F.col("s_nationkey") == nation.n_nationkey)
            .select(*snap, F.concat("n", F.lit("/"), F.col("s_suppkey").cast("string"), ending).alias("file"),
                    _package("l_partkey")))
    key = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(
        "p_partkey", _package("p_partkey"),
        F.when(F.col("p_size") >= 45, F.lit("devDependencies")).otherwise(F.lit("dependencies")).alias("kind"))
    declared = (part.filter(key % 3 == 0).select(F.lit(".").alias("manifest"), "package", "kind")
                .union(part.filter(key % 2 == 0).select(F.concat(F.lit("packages/r"), (key % 5).cast("string")),
                                                        "package", "kind"))
                .union(part.join(F.broadcast(even), key % 25 == even.n_nationkey).select("n", "package", "kind")))
    folders = (nation.select(F.col("r").alias("folder")).distinct().union(even.select("n"))
               .union(spark.range(1).select(F.lit("."))))
    return used, declared.select(*snap, "*"), folders.select(*snap, "folder")


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The manifests of :func:`workspaces` with all kinds of entries: used, scripts(manifest, binary),
    declared(manifest, package, kind, spec), manifests, provided(package, binary), catalog(catalog, package).
    Parts of size 5 and less are optional peers; every fifth part stands in the default catalog and every seventh
    in another; manifests take even parts from the first, multiples of 21 from the other; a part provides a command
    that parts of its size share; scripts call
    those of the parts with return flag A that their nation ships."""
    used, declared, folders = workspaces(spark, sf_dir)
    snap = [F.lit("workspaces").alias("repo"), F.lit("all").alias("snapshot_id")]
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    key = F.col("p_partkey")
    binary = F.concat(F.lit("bin-"), F.col("p_size").cast("string"), F.lit("-"), (key % 40).cast("string")).alias("binary")
    spec = (F.when(key % 21 == 0, F.lit("catalog:old")).when(key % 2 == 0, F.lit("catalog:")).otherwise(F.lit("^1.0.0")))
    more = part.select(_package("p_partkey"), "p_size", spec.alias("spec"))
    declared = declared.join(more, "package").select(
        "repo", "snapshot_id", "manifest", "package",
        F.when(F.col("p_size") <= 5, F.lit("optionalPeerDependencies")).otherwise(F.col("kind")).alias("kind"), "spec")
    nation = read(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 2 == 0).select(
        "n_nationkey", F.concat(F.lit("packages/r"), F.col("n_regionkey").cast("string"), F.lit("/n"),
                                F.col("n_nationkey").cast("string")).alias("manifest"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "A").select("l_suppkey", "l_partkey").distinct()
    scripts = (li.join(supplier, li.l_suppkey == supplier.s_suppkey)
               .join(F.broadcast(nation), F.col("s_nationkey") == nation.n_nationkey)
               .join(part, li.l_partkey == part.p_partkey).select(*snap, "manifest", binary).distinct())
    catalog = (part.filter(key % 5 == 0).select(*snap, F.lit("default").alias("catalog"), _package("p_partkey"))
               .union(part.filter(key % 7 == 0).select(*snap, F.lit("old"), _package("p_partkey"))))
    return used, scripts, declared, folders, part.select(*snap, _package("p_partkey"), binary), catalog


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, path, lines, code, complexity): a file for each part below its brand, whose name is written in
    one of four ways (as it is, capitals, capitals at word starts, after an underscore)."""
    name, key = F.col("p_name"), F.col("p_partkey") % 4
    written = (F.when(key == 0, name).when(key == 1, F.upper(name)).when(key == 2, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000)))
               .otherwise(F.concat(F.lit("_"), name)))
    return read(spark, sf_dir, "part").select(
        F.lit(HISTORY_REPO).alias("repo"), F.lit("all").alias("snapshot_id"),
        F.concat(F.lit(SOURCE_ROOT + "/"), F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")), F.lit("/"), F.regexp_replace(written, " ", "-"),
                 F.lit("."), F.col("p_partkey").cast("string")).alias("path"),
        *[F.col("p_size").cast("bigint").alias(c) for c in ("lines", "code", "complexity")])


# ---- commits ----------------------------------------------------------------
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, short_sha, ts, subject): one repository per customer."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("repo-"), F.col("o_custkey").cast("string")).alias("repo"),
        F.col("o_orderkey").alias("sha"),
        F.lower(F.lpad(F.conv(F.col("o_orderkey").cast("string"), 10, 16), 7, "0")).alias("short_sha"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("fix")).otherwise(F.lit("feat")).alias("subject"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, file, lines): files a commit touches (the parts of the order)."""
    li = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_orderkey").alias("sha"), module_path("p_brand", "l_partkey").alias("file"),
                    F.col("l_quantity").cast("bigint").alias("lines")))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, size): every file a repository's commits touch."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    held = (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.concat(F.lit("repo-"), F.col("o_custkey").cast("string")).alias("repo"), "l_partkey").distinct())
    return held.join(p, held.l_partkey == p.p_partkey).select(
        "repo", module_path("p_brand", "p_partkey").alias("path"), F.col("p_size").alias("size"))


# ---- links (import specifiers): one repository per host -------------------------
CRAWL = "crawl"
HREF = r'href="([^"]*)"'
URL_HOST = r"^[a-z]+://([^/?#]*)"
URL_PATH = r"^[a-z]+://[^/]+(/[^?#]*)"


def _host():
    return F.regexp_extract("url", URL_HOST, 1).alias("repo")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, file, specifier): every distinct link target a page refers to."""
    p = read(spark, sf_dir, "pages")
    return (p.select(_host(), F.lit(CRAWL).alias("snapshot_id"), F.col("url").alias("file"),
                     F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), 1)).alias("specifier"))
            .distinct())


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, snapshot_id, target): the path of every known page."""
    p = read(spark, sf_dir, "pages")
    return p.select(_host(), F.lit(CRAWL).alias("snapshot_id"), F.regexp_extract("url", URL_PATH, 1).alias("target"))
