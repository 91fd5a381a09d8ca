"""Path expressions (column functions) and glob compilation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(col: Column) -> Column:
    """Backslashes to slashes, strip a leading ``./`` and trailing slashes."""
    p = F.translate(col, "\\", "/")
    p = F.regexp_replace(p, r"^\./+", "")
    return F.regexp_replace(p, r"/+$", "")


def repo_relative_path(col: Column, cwd: str) -> Column:
    """Absolute paths under ``cwd`` become relative; others are only normalised."""
    p = normalize_path(col)
    base = cwd.rstrip("/") + "/"
    return (F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 30))
            .otherwise(p))


def within_root(col: Column, root: str) -> Column:
    """Root ``.`` keeps every non-empty path, otherwise equal to or under root."""
    if root == ".":
        return F.length(col) > 0
    return (col == F.lit(root)) | col.startswith(root + "/")


def parent_path(col: Column, root: str) -> Column:
    """Parent directory id; the root has none (NULL)."""
    has_slash = F.instr(col, "/") > 0
    parent = F.regexp_replace(col, "/[^/]*$", "")
    return (F.when(col == F.lit(root), F.lit(None).cast("string"))
            .when(has_slash, parent)
            .otherwise(F.lit(root)))


def base_name(col: Column) -> Column:
    return F.when(col == ".", F.lit(".")).otherwise(F.substring_index(col, "/", -1))


def stem(col: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(col), r"\.[^.]*$", "")


def extension(col: Column) -> Column:
    name = base_name(col)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def ancestor_ids(col: Column, root: str) -> Column:
    """Array of the node itself and every ancestor directory up to the root.

    One array expression per row (no recursion): for a root ``src`` and path
    ``src/a/b.ts`` it yields ``[src/a/b.ts, src/a, src]``.
    """
    parts = F.split(col, "/")
    n = F.size(parts)
    if root == ".":
        prefixes = F.transform(F.sequence(F.lit(1), n),
                               lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        return F.concat(F.reverse(prefixes), F.array(F.lit(".")))
    depth = len(root.split("/"))
    prefixes = F.transform(F.sequence(F.lit(depth), n),
                           lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.reverse(prefixes)


# ---- glob compilation (driver side, once per parameter) ---------------------
# What each piece of a glob stands for in the regular expression; other text is literal.
_PIECES = re.compile(r"(?P<any_depth>\A\*\*/)|(?P<below>/\Z)|(?P<anything>(?<![^/])\*\*(?![^/]))|(?P<in_segment>\*)|(?P<literal>[^*/]+|/)")
_MEANING = {"any_depth": "(^|.*/)", "below": "(/.*)?", "anything": ".*", "in_segment": "[^/]*"}


def glob_to_regex(pattern: str) -> str:
    """Compile an exclusion glob to an anchored regular expression.

    ``**/`` prefix matches at any depth, ``*`` stays inside one segment, a
    trailing ``/`` matches the directory and everything below it.
    """
    path = re.sub("/+", "/", pattern.replace("\\", "/")).removeprefix("/")
    regex = "".join(_MEANING.get(m.lastgroup) or re.escape(m[0]) for m in _PIECES.finditer(path))
    return f"{'' if path.startswith('**/') else '^'}{regex}$"


def _longest_text(pattern: str) -> str:
    """The longest plain text that every path matching the glob contains."""
    path = re.sub("/+", "/", pattern.replace("\\", "/")).removeprefix("/")
    return max((m[0] for m in _PIECES.finditer(path) if m.lastgroup == "literal"), key=len, default="")


def exclude_globs(df, path_col: str, patterns) -> "DataFrame":  # noqa: F821
    """Drop rows whose path matches any of the glob patterns (one rlike each, of the paths that
    contain the glob's plain text)."""
    cond = None
    for pattern in patterns:
        hit = F.contains(F.col(path_col), F.lit(_longest_text(pattern))) & F.col(path_col).rlike(glob_to_regex(pattern))
        cond = hit if cond is None else (cond | hit)
    return df if cond is None else df.filter(~cond)
