"""Unused files, exports, types, members and dependencies.

Everything is a set difference expressed as ``left_anti`` joins on keys
(shuffle joins that partition by the key; no pairs are generated), plus
``groupBy`` counts. Issues end up in one long table
``(repo, snapshot_id, file, kind, name)`` from which the per-snapshot metrics (A3) and per-file
counts (A7) are aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.functions.paths import ancestor_ids, exclude_globs, parent_path
from codehealth.session import saved

SNAP = ["repo", "snapshot_id"]

# ---- fixed values: issue kinds and their metric groups -----------------------------
ISSUE_KINDS = ("dependencies", "devDependencies", "optionalPeerDependencies", "unlisted", "binaries",
               "unresolved", "exports", "nsExports", "classMembers", "types", "nsTypes", "enumMembers",
               "duplicates", "catalog")
EXPORT_KINDS = ("exports", "nsExports", "classMembers", "enumMembers")
TYPE_KINDS = ("types", "nsTypes")
DEPENDENCY_KINDS = ("dependencies", "devDependencies", "optionalPeerDependencies", "unlisted", "binaries",
                    "unresolved", "catalog")
PACKAGE_MANIFEST = "package.json"
# Labels shown for each kind in file details.
KIND_LABELS = {
    "files": "Entire file unused", "dependencies": "Unused dependency", "devDependencies": "Unused devDependency",
    "optionalPeerDependencies": "Unused optional peer dependency", "unlisted": "Unlisted dependency",
    "binaries": "Unused binary", "unresolved": "Unresolved import", "exports": "Unused export",
    "nsExports": "Unused namespace export", "classMembers": "Unused class member", "types": "Unused type",
    "nsTypes": "Unused namespace type", "enumMembers": "Unused enum member", "duplicates": "Duplicate entry",
    "catalog": "Unused catalog entry",
}
# -----------------------------------------------------------------------------------


def unused_exports(exports: DataFrame, imports: DataFrame, entries: DataFrame | None = None,
                   include_entry_exports: bool = False) -> DataFrame:
    """C11: declared (file, symbol) nobody imports; entry files are exempt
    unless ``include_entry_exports``."""
    # joined before it is made distinct: the join's partitions serve both
    out = (exports.select(*SNAP, "file", "symbol", "kind")
           .join(imports.select(*SNAP, "file", "symbol"), [*SNAP, "file", "symbol"], "left_anti").distinct())
    if entries is not None and not include_entry_exports:
        out = out.join(entries.select(*SNAP, "file"), [*SNAP, "file"], "left_anti")
    return out


def duplicate_exports(export_rows: DataFrame) -> DataFrame:
    """A symbol exported more than once from one file."""
    return (export_rows.groupBy(*SNAP, "file", "symbol").agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def unused_dependencies(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Declared packages that no file uses."""
    return declared.join(used.select(*SNAP, "package").distinct(), [*SNAP, "package"], "left_anti")


def unlisted_dependencies(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Packages used by a file but not declared."""
    # a difference needs no distinct right side, which would be dealt out once more
    return (used.join(declared.select(*SNAP, "package"), [*SNAP, "package"], "left_anti")
            .select(*SNAP, "file", "package"))


def unresolved_imports(specifiers: DataFrame, targets: DataFrame) -> DataFrame:
    """C14: import specifiers that resolve to no known module."""
    known = targets.select(*SNAP, F.col("target").alias("specifier"))
    return specifiers.join(known, [*SNAP, "specifier"], "left_anti")


def issue_table(unused_files: DataFrame | None = None, exports: DataFrame | None = None,
                duplicates: DataFrame | None = None, dependencies: DataFrame | None = None,
                unlisted: DataFrame | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """U1 for unused issues: one long (repo, snapshot_id, file, kind, name) table."""
    parts = []
    if unused_files is not None:
        parts.append(unused_files.select(*SNAP, F.col("path").alias("file"), F.lit("files").alias("kind"),
                                         F.col("path").alias("name")))
    if exports is not None:
        parts.append(exports.select(*SNAP, "file", "kind", F.col("symbol").alias("name")))
    if duplicates is not None:
        parts.append(duplicates.select(*SNAP, "file", F.lit("duplicates").alias("kind"), F.col("symbol").alias("name")))
    if dependencies is not None:
        parts.append(dependencies.select(*SNAP, F.lit(PACKAGE_MANIFEST).alias("file"), "kind",
                                         F.col("package").alias("name")))
    if unlisted is not None:
        parts.append(unlisted.select(*SNAP, "file", F.lit("unlisted").alias("kind"), F.col("package").alias("name")))
    if unresolved is not None:
        parts.append(unresolved.select(*SNAP, "file", F.lit("unresolved").alias("kind"),
                                       F.col("specifier").alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Files that are not production code (tests, stories, fixtures).
NON_PRODUCTION_GLOBS = ("**/*.test.*", "**/*.spec.*", "**/__tests__/", "**/test/", "**/*.stories.*")


def filter_issues(issues: DataFrame, include=(), exclude=(), workspace: str | None = None,
                  tags_include=(), tags_exclude=(), production: bool = False) -> DataFrame:
    """P5: include / exclude kinds, workspace prefix, tag filters (on the
    issue table's ``tags`` array; an error without one) and production-only mode (drops
    non-production files and dev dependencies)."""
    out = issues
    if include:
        out = out.filter(F.col("kind").isin(list(include)))
    if exclude:
        out = out.filter(~F.col("kind").isin(list(exclude)))
    if workspace:
        out = out.filter(F.col("file").startswith(workspace.rstrip("/") + "/"))
    if tags_include or tags_exclude:
        for t in tags_include:
            out = out.filter(F.array_contains("tags", t))
        for t in tags_exclude:
            out = out.filter(~F.coalesce(F.array_contains("tags", t), F.lit(False)))
    if production:
        out = exclude_globs(out, "file", NON_PRODUCTION_GLOBS).filter(F.col("kind") != "devDependencies")
    return out


# ---- workspaces (P5 strict, C12, C13) ----------------------------------------------------
def workspace_owners(folders: DataFrame, manifests: DataFrame, strict: bool = False) -> DataFrame:
    """The manifest folders that a folder may take packages from: (snapshot, folder, manifest).

    All folders on the way up that hold a manifest (``.`` is the root), or with
    ``strict`` the nearest alone. Every folder is exploded to its ancestors, so this is one equal
    join whose rows grow with the depth, not with the manifests.
    """
    up = folders.select(*SNAP, "folder").distinct().select(
        *SNAP, "folder", F.explode(F.array_distinct(ancestor_ids(F.col("folder"), "."))).alias("manifest"))
    owners = up.join(manifests.select(*SNAP, F.col("folder").alias("manifest")).distinct(), [*SNAP, "manifest"])
    if strict:
        depth = F.when(F.col("manifest") == ".", 0).otherwise(F.size(F.split("manifest", "/")))
        owners = owners.groupBy(*SNAP, "folder").agg(F.max_by("manifest", depth).alias("manifest"))
    return owners.select(*SNAP, "folder", "manifest")


def workspace_issues(used: DataFrame, declared: DataFrame, manifests: DataFrame, strict: bool = False,
                     workspace: str | None = None) -> DataFrame:
    """Unused and unlisted packages of repositories with several manifests: (snapshot, file, kind, name).

    ``used(file, package)``, ``declared(manifest, package, kind)``, ``manifests(folder)``. A
    package counts as used for every manifest that its file may take packages from, and is
    unlisted if none of these declares it. ``strict`` looks at production files and direct
    dependencies of the nearest manifest only: what an outer manifest declares doesn't help,
    development dependencies neither count as declared nor are reported. ``workspace`` keeps the issues
    of a folder and those below it. Rows without a file, folder or package are left out.
    """
    used = used.filter(F.col("file").isNotNull() & F.col("package").isNotNull()).select(*SNAP, "file", "package")
    declared = declared.filter(F.col("manifest").isNotNull() & F.col("package").isNotNull())
    if strict:
        used = exclude_globs(used, "file", NON_PRODUCTION_GLOBS)
        declared = declared.filter(F.col("kind") != "devDependencies")
    used = saved(used.distinct().withColumn("folder", parent_path(F.col("file"), ".")))
    wants = saved(used.select(*SNAP, "folder", "package").distinct())
    offers = wants.join(workspace_owners(wants, manifests, strict), [*SNAP, "folder"])
    unused = declared.select(*SNAP, "manifest", "package", "kind").distinct().join(
        offers.select(*SNAP, "manifest", "package"), [*SNAP, "manifest", "package"], "left_anti")
    listed = offers.join(declared.select(*SNAP, "manifest", "package"), [*SNAP, "manifest", "package"], "left_semi")
    unlisted = used.join(listed.select(*SNAP, "folder", "package"), [*SNAP, "folder", "package"], "left_anti")
    manifest = F.when(F.col("manifest") == ".", F.lit(PACKAGE_MANIFEST)).otherwise(
        F.concat("manifest", F.lit("/" + PACKAGE_MANIFEST)))
    out = unused.select(*SNAP, manifest.alias("file"), "kind", F.col("package").alias("name")).union(
        unlisted.select(*SNAP, "file", F.lit("unlisted"), "package"))
    return filter_issues(out, workspace=workspace)


def manifest_issues(used: DataFrame, scripts: DataFrame, declared: DataFrame, manifests: DataFrame,
                    provided: DataFrame, catalog: DataFrame) -> DataFrame:
    """C12 and C13 over several manifests, all package kinds: (snapshot, file, kind, name).

    ``used(file, package)``, ``scripts(manifest, binary)`` the commands that a manifest's scripts call,
    ``declared(manifest, package, kind, spec)``, ``manifests(folder)``, ``provided(package, binary)``,
    ``catalog(catalog, package)``. What a manifest declares serves its folder and all below.

    * ``dependencies``, ``devDependencies``: no file imports the package and no script calls a
      command that it provides.
    * ``optionalPeerDependencies``: a file uses a package that is declared as an optional peer only.
    * ``unlisted``: a file uses a package that no manifest above it declares at all.
    * ``binaries``: a script calls a command that no package declared above it provides.
    * ``catalog``: no manifest takes the entry (``spec`` is ``catalog:`` and the catalog's name; none is
      ``default``); its name is ``<catalog>.<package>``, its file the root manifest.

    Commands and their providers meet in semi joins only, so a command that many packages
    provide and many scripts call makes no pairs. Rows with nulls in a key are left out, repeats count once.
    """
    optional = F.col("kind") == "optionalPeerDependencies"
    used = saved(used.select(*SNAP, "file", "package").dropna().distinct().withColumn("folder", parent_path(F.col("file"), ".")))
    declared = declared.select(*SNAP, "manifest", "package", "kind", "spec").dropna(subset=[*SNAP, "manifest", "package", "kind"])
    own = declared.filter(~optional).select(*SNAP, "manifest", "package", "kind").distinct()
    calls = saved(scripts.select(*SNAP, F.col("manifest").alias("folder"), "binary").dropna().distinct())
    wants = saved(used.select(*SNAP, "folder", "package").distinct())
    owners = workspace_owners(wants.select(*SNAP, "folder").union(calls.select(*SNAP, "folder")), manifests)
    key = [*SNAP, "manifest", "package"]

    offers = wants.join(owners, [*SNAP, "folder"])
    offered = calls.join(owners, [*SNAP, "folder"])
    holds = own.join(provided.select(*SNAP, "package", "binary").dropna().distinct(), [*SNAP, "package"])
    called = holds.join(offered.select(*SNAP, "manifest", "binary"), [*SNAP, "manifest", "binary"], "left_semi")
    served = offered.join(holds.select(*SNAP, "manifest", "binary"), [*SNAP, "manifest", "binary"], "left_semi")

    unused = own.join(offers.select(key).union(called.select(key)), key, "left_anti")
    listed = offers.join(own, key, "left_semi").select(*SNAP, "folder", "package")
    peers = (offers.join(declared.filter(optional), key, "left_semi").select(*SNAP, "folder", "package").distinct()
             .withColumn("peer", F.lit(True)))
    open_ = used.join(listed, [*SNAP, "folder", "package"], "left_anti").join(peers, [*SNAP, "folder", "package"], "left")
    missing = calls.join(served.select(*SNAP, "folder", "binary"), [*SNAP, "folder", "binary"], "left_anti")
    taken = declared.filter(F.col("spec").startswith("catalog:")).select(
        *SNAP, F.coalesce(F.nullif(F.substr("spec", F.lit(len("catalog:") + 1)), F.lit("")), F.lit("default")).alias("catalog"), "package")
    spare = catalog.select(*SNAP, "catalog", "package").dropna().distinct().join(taken, [*SNAP, "catalog", "package"], "left_anti")

    def at(folder: str):
        return F.when(F.col(folder) == ".", F.lit(PACKAGE_MANIFEST)).otherwise(
            F.concat(folder, F.lit("/" + PACKAGE_MANIFEST))).alias("file")
    kind = F.when(F.col("peer"), F.lit("optionalPeerDependencies")).otherwise(F.lit("unlisted")).alias("kind")
    return (unused.select(*SNAP, at("manifest"), "kind", F.col("package").alias("name"))
            .union(open_.select(*SNAP, "file", kind, "package"))
            .union(missing.select(*SNAP, at("folder"), F.lit("binaries"), "binary"))
            .union(spare.select(*SNAP, F.lit(PACKAGE_MANIFEST), F.lit("catalog"), F.concat_ws(".", "catalog", "package"))))


def unused_metrics(issues: DataFrame) -> DataFrame:
    """A3: per snapshot unused files, exports, types, dependencies and the total (which
    also counts duplicate exports, included in no sub-total)."""
    k = F.col("kind")
    return issues.groupBy(*SNAP).agg(
        F.count_if(k == "files").alias("unused_files"),
        F.count_if(k.isin(list(EXPORT_KINDS))).alias("unused_exports"),
        F.count_if(k.isin(list(TYPE_KINDS))).alias("unused_types"),
        F.count_if(k.isin(list(DEPENDENCY_KINDS))).alias("unused_dependencies"),
        F.count(F.lit(1)).alias("total_issues"))


def unused_by_file(issues: DataFrame) -> DataFrame:
    """Issues per file (a whole unused file counts 1); rows without a
    file are skipped."""
    return (issues.filter(F.col("file").isNotNull() & (F.col("file") != ""))
            .groupBy(*SNAP, "file").agg(F.count(F.lit(1)).alias("unused")))


def max_issues_gate(metrics: DataFrame, max_issues: int) -> DataFrame:
    """C9 (unused): the run fails when the total exceeds ``max_issues``."""
    return metrics.withColumn("exceeds_max_issues", F.col("total_issues") > F.lit(max_issues))
