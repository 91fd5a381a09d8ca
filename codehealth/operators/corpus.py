"""Line statistics and corpus-level measures over source text.

Input: ``source_files(repo, snapshot_id, path, language, content)``.
All work is column expressions inside one projection per file (whole-stage
codegen, no Python); roll-ups are ``groupBy`` with map-side partial
aggregation, so a repository holding a third of all files still only ships
one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


SNAP = ["repo", "snapshot_id"]

# ---- fixed values of the line classifier ------------------------------------
# A blank line holds only spaces, tabs or a carriage return.
BLANK_LINE = r"^[ \t\r]*$"
# A comment line starts (after indentation) with a marker of its language, or with any
# of the markers if the language is not listed.
COMMENT_LINE = r"^[ \t]*(//|#|/\*|\*|--)"
LINE_MARKERS = {"//": ("c", "cpp", "cs", "css", "go", "java", "javascript", "js", "jsx", "kt", "rs", "rust", "scala",
                       "scss", "swift", "ts", "tsx", "typescript"),
                "#": ("py", "python", "rb", "ruby", "sh", "shell", "toml", "yaml", "yml"),
                "--": ("hs", "lua", "sql")}
# In languages of the first kind, and in SQL, a block comment spans lines.
BLOCK_LANGUAGES = (*LINE_MARKERS["//"], "sql")
BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
# A string ends on its line, unless its language lets it span lines.
SHORT_STRINGS = (r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'")
LONG_STRINGS = {("js", "jsx", "ts", "tsx", "javascript", "typescript", "go"): (r"`[^`\\]*+(?:(?s:\\.)[^`\\]*+)*+(?:`|\\?\z)",),
                ("py", "python"): (r'"""(?s:.*?)(?:"""|\z)', r"'''(?s:.*?)(?:'''|\z)"),
                ("sql",): (r"'[^']*+(?:'|\z)",)}
# Branch keywords and operators counted as complexity.
BRANCH_KEYWORDS = ("if", "for", "while", "case", "catch")
BRANCH_OPERATORS = r"&&|\|\||==|!="
WORD_CHAR = r"[\p{L}\p{N}_]"
# Minified / generated detection.
MINIFIED_AVG_LINE = 255
GENERATED_HEADER = r"(?i)(@generated|do not edit)"
# Basic COCOMO (organic mode) coefficients.
COCOMO_A = 2.4
COCOMO_B = 1.05
# -----------------------------------------------------------------------------

# One scan counts both: keywords are letters and operators are symbols, so
# their matches never overlap. The leading one-character lookahead rejects
# most positions before the (costlier) Unicode word-boundary lookbehind runs.
_FIRST_CHARS = "".join(sorted({k[0] for k in BRANCH_KEYWORDS})) + "&|=!"
_BRANCH_RX = ("(?=[" + _FIRST_CHARS + "])(?:(?<!" + WORD_CHAR + ")(?:" + "|".join(BRANCH_KEYWORDS) + ")(?!"
              + WORD_CHAR + ")|" + BRANCH_OPERATORS + ")")


def _marked_lines(content, marker: str, blocks: bool, long_strings: tuple[str, ...]):
    """The lines of a text with what they hold: ``x`` for code and strings, ``c`` for comments.

    One scan cuts the text into strings, comments and what lies between; what opens
    first wins, so a marker in a string is code and a quote in a comment is not a string.
    Every line that a comment or string reaches is marked, blank ones too.
    """
    line_comment = f"{marker}[^\n]*+"
    parts = [*([BLOCK_COMMENT] if blocks else []), line_comment, *long_strings, *SHORT_STRINGS,
             r"[^\"'`/#-]++", "(?s:.)"]
    tokens = F.regexp_extract_all(content, F.lit("|".join(f"(?:{x})" for x in parts)), 0)

    def reach(token, sign):
        return F.concat(F.lit(sign), F.replace(F.regexp_replace(token, r"[^\n]++", ""), F.lit("\n"), F.lit("\n" + sign)))

    def mark(token):
        comment = token.startswith(marker)
        if blocks:
            comment = comment | token.startswith("/*")
        return (F.when(comment, reach(token, "c"))
                .when((F.length(token) > 1) & token.rlike("^[\"'`]"), reach(token, "x"))
                .otherwise(F.regexp_replace(token, r"[^ \t\r\n]++", "x")))
    return F.split(F.array_join(F.transform(tokens, mark), ""), "\n", -1)


def line_stats(files: DataFrame) -> DataFrame:
    """Per file lines, blanks, comments, code and complexity.

    In the languages of ``LINE_MARKERS`` a line with anything outside comments is code, one
    that only comments reach a comment (blank lines inside a block comment too; an
    unclosed one reaches the end); markers inside strings are code. Regular-expression
    literals and nested block comments are not told apart. In other languages a line
    that starts with one of the markers is a comment. A NULL content has NULL counts.
    """
    language = F.lower("language")
    lines = F.split("content", "\n", -1)
    marked = F.transform(lines, lambda x: F.when(x.rlike(BLANK_LINE), F.lit(""))
                         .when(x.rlike(COMMENT_LINE), F.lit("c")).otherwise(F.lit("x")))
    for marker, languages in LINE_MARKERS.items():
        kinds: dict[tuple, list[str]] = {}
        for name in languages:
            strings = next((v for k, v in LONG_STRINGS.items() if name in k), ())
            kinds.setdefault((name in BLOCK_LANGUAGES, strings), []).append(name)
        for (blocks, strings), names in kinds.items():
            marked = F.when(language.isin(*names),
                            _marked_lines(F.col("content"), marker, blocks, strings)).otherwise(marked)
    complexity = F.regexp_count(F.col("content"), F.lit(_BRANCH_RX))
    # the marks are read twice, so they get a projection of their own
    out = files.select(*SNAP, "path", "language", F.size(lines).cast("bigint").alias("lines"), marked.alias("marked"),
                       complexity.cast("bigint").alias("complexity"),
                       F.octet_length("content").cast("bigint").alias("bytes"))
    code = F.size(F.filter("marked", lambda x: F.contains(x, F.lit("x"))))
    comments = F.size(F.filter("marked", lambda x: ~F.contains(x, F.lit("x")) & F.contains(x, F.lit("c"))))
    out = (out.withColumn("code", code.cast("bigint")).withColumn("comments", comments.cast("bigint"))
           .withColumn("blanks", F.col("lines") - F.col("code") - F.col("comments")))
    return out.select(*SNAP, "path", "language", "lines", "blanks", "comments", "complexity", "bytes", "code")


def overview_files(files: DataFrame, no_min_gen: bool = True, no_duplicates: bool = False) -> DataFrame:
    """The files an overview counts: without minified and generated ones by default, and
    one file per content on demand."""
    if no_min_gen:
        files = files.join(minified_or_generated(files).select(*SNAP, "path"), [*SNAP, "path"], "left_anti")
    if no_duplicates:
        files = files.join(drop_duplicate_files(files).select(*SNAP, "path"), [*SNAP, "path"], "left_semi")
    return files


def language_overview(stats: DataFrame) -> DataFrame:
    """A1: per (snapshot, language) totals, ranked lines desc then name."""
    per_lang = stats.groupBy(*SNAP, "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("lines").alias("lines"),
        F.sum("code").alias("code"),
        F.sum("complexity").alias("complexity"),
        F.sum("blanks").alias("blanks"),
        F.sum("comments").alias("comments"),
    )
    w = Window.partitionBy(*SNAP).orderBy(F.desc("lines"), F.asc("language"))
    return per_lang.withColumn("position", F.row_number().over(w).cast("bigint"))


def overview_totals(stats: DataFrame) -> DataFrame:
    """A1 totals: one row per snapshot (no row for an empty snapshot)."""
    return stats.groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("lines").alias("total_lines"),
        F.sum("code").alias("total_code"),
        F.sum("complexity").alias("total_complexity"),
        F.sum("blanks").alias("total_blanks"),
        F.sum("comments").alias("total_comments"),
    )


def top_files(stats: DataFrame, by: str = "complexity", top: int = 25,
              max_lines: int | None = None) -> DataFrame:
    """Top files per snapshot.

    complexity: complexity desc, lines desc, path asc; lines: lines desc,
    complexity desc, path asc. ``row_number() <= k`` is planned as a partial
    WindowGroupLimit before the shuffle, so each map task sends at most k rows
    per snapshot.
    """
    if by == "complexity":
        order = [F.desc("complexity"), F.desc("lines"), F.asc("path")]
    elif by == "lines":
        order = [F.desc("lines"), F.desc("complexity"), F.asc("path")]
    else:
        raise ValueError(f"unknown ranking {by!r}")
    if max_lines is not None:  # an explicit large-line cutoff
        stats = stats.filter(F.col("lines") <= max_lines)
    w = Window.partitionBy(*SNAP).orderBy(*order)
    ranked = stats.withColumn("position", F.row_number().over(w))
    return (ranked.filter(F.col("position") <= top)
            .select(*SNAP, F.col("position").cast("bigint").alias("position"), "path",
                    "lines", "code", "complexity"))


def drop_duplicate_files(files: DataFrame) -> DataFrame:
    """Keep one file per identical content (the smallest path).

    A ``groupBy`` on the content hash with ``min(path)`` partially aggregates
    map-side, so a hot content shared by a third of all files costs one row
    per map task; no window over the hot group is needed.
    """
    keyed = files.withColumn("content_hash", F.sha2(F.col("content"), 256))
    return (keyed.groupBy(*SNAP, "content_hash")
            .agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies")))


def minified_or_generated(files: DataFrame) -> DataFrame:
    """Files whose average line is longer than 255 chars or whose first line
    says they are generated."""
    n_lines = F.size(F.split(F.col("content"), "\n", -1))
    avg_len = F.length("content") / n_lines
    header = F.substring_index(F.col("content"), "\n", 1)
    minified = avg_len > MINIFIED_AVG_LINE
    generated = header.rlike(GENERATED_HEADER)
    return (files.select(*SNAP, "path", minified.alias("minified"), generated.alias("generated"))
            .filter(F.col("minified") | F.col("generated")))


def dryness(files: DataFrame) -> DataFrame:
    """C4: unique non-blank (trimmed) lines / non-blank lines, per snapshot."""
    lines = (files.select(*SNAP, F.explode(F.split(F.col("content"), "\n", -1)).alias("line"))
             .select(*SNAP, F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line"))
             .filter(F.col("line") != ""))
    agg = lines.groupBy(*SNAP).agg(F.count_distinct("line").alias("unique_lines"),
                                   F.count(F.lit(1)).alias("total_lines"))
    return agg.withColumn("dryness", F.col("unique_lines") / F.col("total_lines"))


def cocomo(stats: DataFrame) -> DataFrame:
    """Basic COCOMO effort in person-months from code lines."""
    agg = stats.groupBy(*SNAP).agg(F.sum("code").alias("code"))
    effort = F.lit(COCOMO_A) * F.pow(F.col("code") / F.lit(1000.0), F.lit(COCOMO_B))
    return agg.withColumn("effort_person_months", F.round(effort, 6))


def apply_stats_filters(stats: DataFrame, params) -> DataFrame:
    """P1 + P2: glob exclusions, directory and extension exclusions, not-match,
    maximum line count and maximum byte size."""
    from codehealth.functions.paths import exclude_globs, extension
    out = exclude_globs(stats, "path", params.exclude)
    for d in params.exclude_dir:
        out = out.filter(~F.col("path").rlike(r"(^|/)" + _escape(d) + r"(/|$)"))
    if params.exclude_ext:
        out = out.filter(~extension(F.col("path")).isin(list(params.exclude_ext)))
    if params.not_match:
        out = out.filter(~F.col("path").rlike(params.not_match))
    if params.large_line_count is not None:
        out = out.filter(F.col("lines") <= params.large_line_count)
    if params.large_byte_count is not None:
        out = out.filter(F.col("bytes") <= params.large_byte_count)
    return out


def _escape(s: str) -> str:
    import re
    return re.escape(s)
