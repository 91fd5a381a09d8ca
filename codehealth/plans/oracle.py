"""Reference SQL (DuckDB dialect) for every registered query.

Each statement recomputes the query from the driver tables with plain SQL, so
the Spark plans are checked against an independent formulation. Adapter
CTEs mirror ``codehealth.sources.testdata``.
"""

from __future__ import annotations

# ---- adapter CTEs -------------------------------------------------------------
SOURCE_FILES = r"""
sf AS (
  SELECT source AS repo, 'corpus' AS snapshot_id,
         'src/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         lang AS language, text AS content
  FROM documents)"""

LINE_STATS = SOURCE_FILES + r""",
ls0 AS (
  SELECT repo, snapshot_id, path, language, content, string_split(content, chr(10)) AS ls
  FROM sf),
ls AS (
  SELECT repo, snapshot_id, path, language,
         CAST(len(ls) AS BIGINT) AS lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t\r]*$'))) AS BIGINT) AS blanks,
         CAST(len(list_filter(ls, lambda x: NOT regexp_matches(x, '^[ \t\r]*$')
                                        AND regexp_matches(x, '^[ \t]*(//|#|/\*|\*|--)'))) AS BIGINT) AS comments,
         CAST(len(list_filter(string_split_regex(content, '[^\p{L}\p{N}_]+'),
                              lambda t: t IN ('if', 'for', 'while', 'case', 'catch')))
              + len(regexp_extract_all(content, '&&|\|\||==|!=')) AS BIGINT) AS complexity,
         CAST(octet_length(encode(content)) AS BIGINT) AS bytes
  FROM ls0),
st AS (
  SELECT *, lines - blanks - comments AS code FROM ls)"""

FILE_HISTORY = r"""
per_order AS (
  SELECT l_orderkey,
         count(*) AS lines,
         count(*) FILTER (WHERE l_linestatus = 'F') AS code,
         sum(CAST(l_quantity AS BIGINT)) AS complexity,
         count(*) FILTER (WHERE l_returnflag = 'R') AS unused,
         count(*) FILTER (WHERE l_returnflag = 'A') AS duplication,
         count(*) FILTER (WHERE l_discount >= 0.09) AS cycles
  FROM lineitem GROUP BY l_orderkey),
fh AS (
  SELECT 'tpch' AS repo, strftime(o.o_orderdate, '%Y-%m') AS snapshot_id,
         CAST(strftime(o.o_orderdate, '%Y-%m') || '-01 00:00:00' AS TIMESTAMP) AS ts,
         'src/' || r.r_name || '/' || n.n_name || '/' || CAST(c.c_custkey AS VARCHAR) AS path,
         CAST(sum(p.lines) AS BIGINT) AS lines, CAST(sum(p.code) AS BIGINT) AS code,
         CAST(sum(p.complexity) AS BIGINT) AS complexity, CAST(sum(p.unused) AS BIGINT) AS unused,
         CAST(sum(p.duplication) AS BIGINT) AS duplication, CAST(sum(p.cycles) AS BIGINT) AS cycles
  FROM per_order p
  JOIN orders o ON p.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY ALL)"""

SNAPSHOT_METRICS = FILE_HISTORY + r""",
sm0 AS (
  SELECT repo, snapshot_id, ts, count(*) AS total_files,
         CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(code) AS BIGINT) AS total_code,
         CAST(sum(complexity) AS BIGINT) AS total_complexity, CAST(sum(unused) AS BIGINT) AS total_issues,
         CAST(sum(duplication) AS BIGINT) AS duplicated_lines, CAST(sum(cycles) AS BIGINT) AS cycle_count
  FROM fh GROUP BY ALL),
sm AS (
  SELECT *, CAST((10000 * duplicated_lines + total_lines // 2) // greatest(total_lines, 1) AS DOUBLE) / 100
            AS duplicated_lines_percent
  FROM sm0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ---- corpus -------------------------------------------------------------------
register("c1_line_stats", with_(LINE_STATS) + """
SELECT repo, snapshot_id, path, language, lines, blanks, comments, code, complexity, bytes FROM st""")

register("a1_language_overview", with_(LINE_STATS) + """
SELECT repo, snapshot_id, language, count(*) AS files,
       CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(code) AS BIGINT) AS code,
       CAST(sum(complexity) AS BIGINT) AS complexity, CAST(sum(blanks) AS BIGINT) AS blanks,
       CAST(sum(comments) AS BIGINT) AS comments,
       CAST(row_number() OVER (PARTITION BY repo, snapshot_id ORDER BY sum(lines) DESC, language) AS BIGINT)
         AS position
FROM st GROUP BY repo, snapshot_id, language""")

register("a1_overview_totals", with_(LINE_STATS) + """
SELECT repo, snapshot_id, count(*) AS total_files,
       CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(code) AS BIGINT) AS total_code,
       CAST(sum(complexity) AS BIGINT) AS total_complexity, CAST(sum(blanks) AS BIGINT) AS total_blanks,
       CAST(sum(comments) AS BIGINT) AS total_comments
FROM st GROUP BY repo, snapshot_id""")

register("t1_top_complexity", with_(LINE_STATS) + """
SELECT repo, snapshot_id, position, path, lines, code, complexity FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, snapshot_id
                                    ORDER BY complexity DESC, lines DESC, path) AS BIGINT) AS position
  FROM st) WHERE position <= 25""")

register("t2_top_lines", with_(LINE_STATS) + """
SELECT repo, snapshot_id, position, path, lines, code, complexity FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, snapshot_id
                                    ORDER BY lines DESC, complexity DESC, path) AS BIGINT) AS position
  FROM st) WHERE position <= 25""")

register("c2_drop_duplicate_files", with_(SOURCE_FILES) + """
SELECT repo, snapshot_id, sha256(content) AS content_hash, min(path) AS path, count(*) AS copies
FROM sf GROUP BY repo, snapshot_id, sha256(content)""")

register("c3_minified_generated", with_(SOURCE_FILES) + r"""
SELECT repo, snapshot_id, path, minified, generated FROM (
  SELECT repo, snapshot_id, path,
         length(content) / len(string_split(content, chr(10))) > 255 AS minified,
         regexp_matches(split_part(content, chr(10), 1), '(?i)(@generated|do not edit)') AS generated
  FROM sf) WHERE minified OR generated""")

register("c4_dryness", with_(SOURCE_FILES) + r"""
, l AS (
  SELECT repo, snapshot_id,
         regexp_replace(unnest(string_split(content, chr(10))), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line
  FROM sf)
SELECT repo, snapshot_id, count(DISTINCT line) AS unique_lines, count(*) AS total_lines,
       count(DISTINCT line) / count(*) AS dryness
FROM l WHERE line <> '' GROUP BY repo, snapshot_id""")

register("c16_cocomo", with_(LINE_STATS) + """
SELECT repo, snapshot_id, CAST(sum(code) AS BIGINT) AS code,
       round(2.4 * pow(CAST(sum(code) AS DOUBLE) / 1000, 1.05), 6) AS effort_person_months
FROM st GROUP BY repo, snapshot_id""")

register("p2_filtered_stats", with_(LINE_STATS) + r"""
SELECT repo, snapshot_id, path, lines, bytes FROM st
WHERE NOT regexp_matches(path, '(^|.*/)de(/.*)?$')
  AND NOT regexp_matches(path, '(^|.*/)[^/]*\.test\.[^/]*$')
  AND NOT regexp_matches(path, '(^|/)src3(/|$)')
  AND lines <= 40 AND bytes <= 100000""")


# ---- tree roll-up over the monthly file history ---------------------------------
TREE = FILE_HISTORY + r""",
ex AS (
  SELECT *, array_to_string(string_split(path, '/')[1:i], '/') AS node,
         i = len(string_split(path, '/')) AS is_self
  FROM (SELECT *, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM fh)),
tree AS (
  SELECT repo, snapshot_id, node AS path,
         string_split(node, '/')[-1] AS name,
         CASE WHEN bool_or(is_self) THEN 'file' ELSE 'dir' END AS kind,
         CASE WHEN node = 'src' THEN NULL
              WHEN contains(node, '/') THEN regexp_replace(node, '/[^/]*$', '')
              ELSE 'src' END AS parent,
         CAST(max(CASE WHEN is_self THEN 1 ELSE 0 END)
              + sum(CASE WHEN is_self THEN 0 ELSE 1 END) AS BIGINT) AS files,
         CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(code) AS BIGINT) AS code,
         CAST(sum(complexity) AS BIGINT) AS complexity, CAST(sum(unused) AS BIGINT) AS unused,
         CAST(sum(duplication) AS BIGINT) AS duplication, CAST(sum(cycles) AS BIGINT) AS cycles,
         CAST(sum(unused) + sum(duplication) + sum(cycles) AS BIGINT) AS total
  FROM ex GROUP BY repo, snapshot_id, node)"""

register("a10_tree_rollup", with_(TREE) + """
SELECT repo, snapshot_id, path, name, kind, parent, files, lines, code, complexity,
       unused, duplication, cycles, total FROM tree""")

register("a11_child_order", with_(TREE) + """
SELECT repo, snapshot_id, parent, path AS child, kind,
       CAST(row_number() OVER (PARTITION BY repo, snapshot_id, parent
                               ORDER BY CASE WHEN kind = 'dir' THEN 0 ELSE 1 END, path) AS BIGINT) AS position
FROM tree WHERE parent IS NOT NULL""")

register("a11_display_order", """
WITH named AS (
  SELECT 'src/' || CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE p_brand END || '/' || replace(
           CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN upper(p_name[1]) || p_name[2:]
                              ELSE '_' || p_name END, ' ', '-') || '.' || CAST(p_partkey AS VARCHAR) AS path FROM part),
kids AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path, 'dir' AS kind FROM named
         UNION SELECT path, 'file' FROM named)
SELECT 'tpch' AS repo, 'all' AS snapshot_id, regexp_replace(path, '/[^/]*$', '') AS parent, path AS child, kind,
       CAST(row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '')
                               ORDER BY CASE WHEN kind = 'dir' THEN 0 ELSE 1 END, path COLLATE en, path COLLATE "binary") AS BIGINT) AS position
FROM kids""")

register("a12_node_counts", with_(TREE) + """
SELECT repo, snapshot_id, count(*) AS node_count, count(*) FILTER (WHERE kind = 'file') AS file_nodes,
       count(*) FILTER (WHERE kind = 'dir') AS dir_nodes, 'src' AS root_id
FROM tree GROUP BY repo, snapshot_id""")

_HOT = """
SELECT repo, snapshot_id, position, path, name, kind, score,
       floor(cs * 100 + 0.5) / 100 AS complexity_signal, floor(ss * 100 + 0.5) / 100 AS size_signal,
       floor(iss * 100 + 0.5) / 100 AS issues_signal, lines, code, complexity, total
FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, snapshot_id ORDER BY score DESC, path) AS BIGINT) AS position
  FROM (
    SELECT *, CAST(floor(({score}) * 100 + 0.5) AS BIGINT) AS score
    FROM (
      SELECT *, complexity / greatest(max(complexity) OVER w, 1) AS cs,
                lines / greatest(max(lines) OVER w, 1) AS ss,
                total / greatest(max(total) OVER w, 1) AS iss
      FROM tree WHERE {where}
      WINDOW w AS (PARTITION BY repo, snapshot_id)))
  WHERE score > 0)
WHERE position <= {limit}"""

register("t5_file_hotspots", with_(TREE) + _HOT.format(
    score="cs * 0.35 + ss * 0.25 + iss * 0.4", where="kind = 'file'", limit=10))
register("t6_dir_hotspots", with_(TREE) + _HOT.format(
    score="iss * 0.45 + cs * 0.35 + ss * 0.2", where="kind = 'dir' AND path <> 'src'", limit=5))

_TOPF = """
SELECT repo, snapshot_id, position, path, name, '{m}' AS primary_metric, {m} AS primary_value,
       lines, code, complexity, total
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo, snapshot_id ORDER BY {order}, path) AS BIGINT)
                AS position FROM tree WHERE kind = 'file')
WHERE position <= 10"""
register("t7_largest_files", with_(TREE) + _TOPF.format(
    m="code", order="code DESC, lines DESC, complexity DESC"))
register("t8_most_complex_files", with_(TREE) + _TOPF.format(
    m="complexity", order="complexity DESC, code DESC, lines DESC"))

register("a14_health_trend", with_(TREE.replace(FILE_HISTORY, FILE_HISTORY + """,
sm0 AS (
  SELECT repo, snapshot_id, ts, count(*) AS total_files,
         CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(code) AS BIGINT) AS total_code,
         CAST(sum(complexity) AS BIGINT) AS total_complexity, CAST(sum(unused) AS BIGINT) AS total_issues,
         CAST(sum(duplication) AS BIGINT) AS duplicated_lines, CAST(sum(cycles) AS BIGINT) AS cycle_count
  FROM fh GROUP BY ALL),
sm AS (
  SELECT *, CAST((10000 * duplicated_lines + total_lines // 2) // greatest(total_lines, 1) AS DOUBLE) / 100
            AS duplicated_lines_percent
  FROM sm0)""")) + """,
tc AS (
  SELECT repo, snapshot_id, count(*) AS file_nodes,
         count(*) FILTER (WHERE code > 350) AS oversized_files,
         count(*) FILTER (WHERE complexity > 10) AS overly_complex_files
  FROM tree WHERE kind = 'file' GROUP BY ALL),
j AS (
  SELECT sm.*, tc.file_nodes, tc.oversized_files, tc.overly_complex_files,
         greatest(coalesce(CASE WHEN tc.file_nodes > 0 THEN tc.file_nodes END,
                           CASE WHEN sm.total_files > 0 THEN sm.total_files END, 0), 1) AS denom
  FROM sm LEFT JOIN tc USING (repo, snapshot_id)),
s AS (
  SELECT repo, snapshot_id, ts,
    CAST(floor(greatest(0.0, 100 - duplicated_lines_percent * 5.0) + 0.5) AS BIGINT) AS duplication_score,
    CAST(floor(greatest(0.0, 100 - (total_issues / greatest(total_files, 1)) * 50.0) + 0.5) AS BIGINT) AS unused_score,
    CAST(floor(greatest(0.0, 100 - (total_complexity / greatest(total_code, 1) * 100) * 2.5) + 0.5) AS BIGINT)
      AS complexity_score,
    CAST(floor(greatest(0.0, 100 - coalesce(oversized_files, 0) / denom * 100) + 0.5) AS BIGINT)
      AS oversized_files_score,
    CAST(floor(greatest(0.0, 100 - coalesce(overly_complex_files, 0) / denom * 100) + 0.5) AS BIGINT)
      AS overly_complex_files_score,
    duplicated_lines_percent AS duplication_display,
    coalesce(oversized_files, 0) / denom * 100 AS oversized_files_percent,
    coalesce(overly_complex_files, 0) / denom * 100 AS overly_complex_files_percent
  FROM j),
o AS (
  SELECT *, CAST(floor(((((duplication_score * 0.2 + unused_score * 0.2) + complexity_score * 0.2)
                        + oversized_files_score * 0.2) + overly_complex_files_score * 0.2) + 0.5) AS BIGINT)
            AS overall
  FROM s)
SELECT *, CAST(coalesce(overall - lag(overall) OVER (PARTITION BY repo ORDER BY ts, snapshot_id), 0) AS BIGINT)
          AS trend
FROM o""")


# ---- history over daily check results -------------------------------------------
CHECKS = r"""
cr AS (
  SELECT 'events' AS repo, strftime(ts, '%Y-%m-%d') AS snapshot_id, ts, event_id AS check_idx,
         event_type AS name,
         CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' WHEN 'click' THEN 'warn'
                         ELSE 'pass' END AS status,
         CAST(floor(value * 1000 + 0.5) AS BIGINT) AS duration_ms,
         CASE event_type WHEN 'purchase' THEN 'stats-overview' WHEN 'signup' THEN 'unused'
                         WHEN 'click' THEN 'duplicates' WHEN 'error' THEN 'cycles' END AS kind,
         user_id AS count_value, value AS percent_value, props AS output
  FROM events),
snaps AS (
  SELECT repo, snapshot_id, min(ts) AS ts, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
         count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'warn') AS warn,
         count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'skip') AS skip,
         bool_or(status = 'fail') AS failed
  FROM cr GROUP BY repo, snapshot_id),
fm AS (
  SELECT repo, snapshot_id, kind, min(check_idx) AS check_idx, arg_min(name, check_idx) AS name,
         arg_min(count_value, check_idx) AS count_value, arg_min(percent_value, check_idx) AS percent_value
  FROM cr WHERE kind IS NOT NULL GROUP BY repo, snapshot_id, kind),
tv0 AS (
  SELECT repo, snapshot_id,
         max(CASE WHEN kind = 'stats-overview' THEN count_value END) AS lines,
         max(CASE WHEN kind = 'stats-overview' THEN CAST(floor(percent_value) AS BIGINT) END) AS complexity,
         max(CASE WHEN kind = 'unused' THEN count_value END) AS unused,
         max(CASE WHEN kind = 'duplicates' THEN percent_value END) AS duplication,
         max(CASE WHEN kind = 'cycles' THEN count_value END) AS cycles,
         count(DISTINCT kind) FILTER (WHERE kind IN ('stats-overview', 'unused', 'duplicates', 'cycles')) AS kinds
  FROM fm GROUP BY repo, snapshot_id),
tv AS (
  SELECT repo, snapshot_id,
         CASE WHEN kinds = 4 THEN lines END AS lines, CASE WHEN kinds = 4 THEN complexity END AS complexity,
         CASE WHEN kinds = 4 THEN unused END AS unused, CASE WHEN kinds = 4 THEN duplication END AS duplication,
         CASE WHEN kinds = 4 THEN cycles END AS cycles
  FROM tv0)"""

# display helpers: tenths of the exact binary value, halves up
def _tenths(x):
    exact = f"CAST((({x}) - floor({x})) * 144115188075855872 AS HUGEINT)"
    return (f"(CAST(floor({x}) AS BIGINT) * 10 + CAST(({exact} * 10 + 72057594037927936) "
            f"// 144115188075855872 AS BIGINT))")


def _num(x):
    return f"coalesce(format('{{:,}}', CAST({x} AS BIGINT)), '-')"


def _pct(x):
    t = _tenths(x)
    return f"coalesce(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%', '-')"


def _delta(d):
    return (f"CASE WHEN ({d}) = 0 THEN '=' WHEN ({d}) > 0 THEN '+' || format('{{:,}}', CAST({d} AS BIGINT)) "
            f"ELSE '-' || format('{{:,}}', CAST(abs({d}) AS BIGINT)) END")


def _pct_delta(d):
    t = _tenths(f"abs({d})")
    return (f"CASE WHEN {t} = 0 THEN '=' ELSE (CASE WHEN ({d}) > 0 THEN '+' ELSE '-' END) || "
            f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%' END")


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"

register("a2_status_counts", with_(CHECKS) + """
SELECT repo, snapshot_id, pass, warn, fail, skip, failed FROM snaps""")

register("p6_first_metric", with_(CHECKS) + """
SELECT repo, snapshot_id, kind, check_idx, name, count_value, percent_value FROM fm""")

register("a13_trend_vector", with_(CHECKS) + """
SELECT repo, snapshot_id, lines, complexity, unused, duplication, cycles FROM tv""")

for _name in ("w1_metric_deltas", "w1_streamed_deltas"):
    register(_name, with_(CHECKS) + """
, t AS (SELECT tv.*, snaps.ts FROM tv JOIN snaps USING (repo, snapshot_id))
SELECT repo, snapshot_id, lines, complexity, unused, duplication, cycles,
       lines - lag(lines) OVER w AS lines_delta,
       complexity - lag(complexity) OVER w AS complexity_delta,
       unused - lag(unused) OVER w AS unused_delta,
       sign(duplication - lag(duplication) OVER w) * floor(abs(duplication - lag(duplication) OVER w) * 10 + 0.5)
         / 10 + 0.0 AS duplication_delta,
       cycles - lag(cycles) OVER w AS cycles_delta
FROM t WINDOW w AS (PARTITION BY repo ORDER BY ts, snapshot_id)""")

register("f9_trend_line", with_(CHECKS) + f"""
, t AS (
  SELECT tv.*, lag(lines) OVER w AS prev_lines, lag(complexity) OVER w AS prev_complexity,
         lag(unused) OVER w AS prev_unused, lag(duplication) OVER w AS prev_duplication,
         lag(cycles) OVER w AS prev_cycles
  FROM tv JOIN snaps USING (repo, snapshot_id) WINDOW w AS (PARTITION BY repo ORDER BY ts, snapshot_id))
SELECT repo, snapshot_id,
  CASE WHEN lines IS NOT NULL AND prev_lines IS NOT NULL AND complexity IS NOT NULL
        AND prev_complexity IS NOT NULL AND unused IS NOT NULL AND prev_unused IS NOT NULL
        AND duplication IS NOT NULL AND prev_duplication IS NOT NULL AND cycles IS NOT NULL
        AND prev_cycles IS NOT NULL THEN
    'Lines ' || {_num('lines')} || ' (' || {_delta('lines - prev_lines')} || ')' || ' · ' ||
    'Complexity ' || {_num('complexity')} || ' (' || {_delta('complexity - prev_complexity')} || ')' || ' · ' ||
    'Unused ' || {_num('unused')} || ' (' || {_delta('unused - prev_unused')} || ')' || ' · ' ||
    'Duplication ' || {_pct('duplication')} || ' (' || {_pct_delta('duplication - prev_duplication')} || ')'
    || ' · ' || 'Cycles ' || {_num('cycles')} || ' (' || {_delta('cycles - prev_cycles')} || ')'
  END AS trend_line
FROM t""")

register("a15_snapshot_range", with_(CHECKS) + f"""
SELECT repo, {ISO.format('min(ts)')} AS start, {ISO.format('max(ts)')} AS "end" FROM snaps GROUP BY repo""")

register("w6_positions", with_(CHECKS) + """
SELECT repo, snapshot_id, CAST(row_number() OVER w AS BIGINT) AS position,
       count(*) OVER (PARTITION BY repo) AS total,
       lag(snapshot_id) OVER w AS previous_id, lead(snapshot_id) OVER w AS next_id
FROM snaps WINDOW w AS (PARTITION BY repo ORDER BY ts, snapshot_id)""")

register("w5_last_n", with_(CHECKS) + """
SELECT repo, snapshot_id, age <= 10 AS in_last_10, total > 10 AS show_last_10,
       age <= 25 AS in_last_25, total > 25 AS show_last_25
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, snapshot_id DESC) AS age,
             count(*) OVER (PARTITION BY repo) AS total FROM snaps)""")

_DAY = "day(ts)"
register("t10_history_listing", with_(CHECKS) + f"""
SELECT s.repo, s.snapshot_id,
  CAST(row_number() OVER (PARTITION BY s.repo ORDER BY ts DESC, s.snapshot_id DESC) AS BIGINT) AS position,
  {ISO.format('ts')} AS timestamp,
  strftime(ts, '%a, %b ') || CAST({_DAY} AS VARCHAR) ||
    CASE WHEN {_DAY} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {_DAY} % 10 = 1 THEN 'st'
         WHEN {_DAY} % 10 = 2 THEN 'nd' WHEN {_DAY} % 10 = 3 THEN 'rd' ELSE 'th' END
    || ' ' || CAST(year(ts) AS VARCHAR) AS label,
  printf('%dp/%dw/%df/%ds', pass, warn, fail, skip) AS status,
  CASE WHEN duration_ms < 1000 THEN CAST(duration_ms AS VARCHAR) || 'ms'
       ELSE CAST({_tenths('duration_ms / 1000')} // 10 AS VARCHAR) || '.' ||
            CAST({_tenths('duration_ms / 1000')} % 10 AS VARCHAR) || 's' END AS duration,
  {_num('lines')} AS lines, {_num('complexity')} AS complexity, {_num('unused')} AS unused,
  {_pct('duplication')} AS duplication, {_num('cycles')} AS cycles
FROM snaps s LEFT JOIN tv USING (repo, snapshot_id)""")

register("p7_derived_status", with_(CHECKS) + r"""
SELECT repo, snapshot_id, check_idx, name,
  CASE WHEN status IN ('skip', 'fail') THEN status
       WHEN kind IN ('unused', 'duplicates', 'cycles') AND count_value IS NOT NULL THEN
         CASE WHEN count_value > 0 THEN 'warn' ELSE 'pass' END
       WHEN coalesce(kind, name) = 'unused' AND regexp_matches(coalesce(output, ''), 'Unused|unused|Unlisted')
         THEN 'warn'
       WHEN coalesce(kind, name) = 'duplicates'
            AND regexp_matches(coalesce(output, ''), 'Clone found|Found \d+ clones') THEN 'warn'
       WHEN coalesce(kind, name) = 'cycles' AND contains(coalesce(output, ''), 'error no-circular') THEN 'warn'
       ELSE 'pass' END AS derived_status
FROM cr""")

COMMITS = r"""
cm AS (
  SELECT 'repo-' || CAST(o_custkey AS VARCHAR) AS repo, o_orderkey AS sha,
         lpad(lower(hex(o_orderkey)), 7, '0') AS short_sha, o_orderdate AS ts,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'fix' ELSE 'feat' END AS subject
  FROM orders)"""

register("p7_exit_codes", with_(CHECKS) + r"""
SELECT repo, snapshot_id, check_idx, name,
  CASE WHEN kind = 'stats-overview' AND check_idx % 4 <> 0 THEN 'fail'
       WHEN kind IN ('unused', 'duplicates', 'cycles') AND check_idx % 3 > 0 AND count_value IS NOT NULL THEN
         CASE WHEN count_value > 0 THEN 'warn' ELSE 'pass' END
       WHEN kind = 'cycles' AND check_idx % 4 <> 0 THEN 'warn'
       WHEN kind = 'unused' AND regexp_matches(coalesce(output, ''), 'Unused|unused|Unlisted') THEN 'warn'
       WHEN kind = 'duplicates' AND regexp_matches(coalesce(output, ''), 'Clone found|Found \d+ clones') THEN 'warn'
       WHEN kind = 'cycles' AND contains(coalesce(output, ''), 'error no-circular') THEN 'warn'
       ELSE 'pass' END AS derived_status
FROM cr""")

register("w7_short_histories", with_(COMMITS) + """
SELECT repo, count(*) AS available, CAST(7 AS BIGINT) AS needed FROM cm GROUP BY repo HAVING count(*) < 7""")

register("f10_commit_labels", with_(COMMITS) + """
SELECT repo, sha, CASE WHEN sha % 5 = 0 THEN 'nogit' WHEN subject = 'fix' THEN short_sha || '*'
                       ELSE short_sha END AS label FROM cm""")

register("f12_score_tiers", f"""
SELECT repo, snapshot_id, overall,
       CASE WHEN overall >= 80 THEN 'low' WHEN overall >= 50 THEN 'medium' ELSE 'high' END AS tier,
       CASE WHEN overall <= 20 THEN 'low' WHEN overall <= 50 THEN 'medium' ELSE 'high' END AS heat,
       CASE WHEN trend > 0 THEN 'positive' WHEN trend < 0 THEN 'negative' ELSE 'neutral' END AS direction
FROM ({ORACLE["a14_health_trend"]})""")

register("f14_signal_flags", f"""
SELECT repo, snapshot_id, path, complexity_signal >= 0.3 AS complexity_active, size_signal >= 0.3 AS size_active,
       issues_signal >= 0.1 AS issues_active
FROM ({ORACLE["t5_file_hotspots"]})""")


def _compact(x):
    def short(unit, sign):
        t = _tenths(f"abs({x}) / {unit}.0::DOUBLE")
        return f"CASE WHEN ({x}) < 0 THEN '-' ELSE '' END || CAST({t} // 10 AS VARCHAR) || '.' || " \
               f"CAST({t} % 10 AS VARCHAR) || '{sign}'"
    return (f"CASE WHEN ({x}) IS NULL THEN '—' WHEN abs({x}) >= 1000000 THEN {short(1000000, 'M')} "
            f"WHEN abs({x}) >= 1000 THEN {short(1000, 'k')} "
            f"ELSE regexp_replace(printf('%.3f', round(CAST({x} AS DOUBLE), 3)), '\\.?0+$', '') END")


register("f15_compact_numbers", f"""
SELECT c_custkey, {_compact('CAST(c_acctbal AS DOUBLE)')} AS balance,
       {_compact('CAST(c_acctbal AS DOUBLE) * c_custkey')} AS weighted,
       {_compact('nullif(c_custkey % 7, 0)')} AS small
FROM customer""")

register("t9_files_by_path", with_(TREE) + """
SELECT repo, snapshot_id, path, lines, code, complexity, total FROM tree WHERE kind = 'file'""")

register("w7_every_nth_commits", with_(COMMITS) + """
SELECT repo, sha, short_sha, CAST(rn - 1 AS BIGINT) AS idx, CAST(4 - (rn - 1) // 2 AS BIGINT) AS "order"
FROM (SELECT *, count(*) OVER (PARTITION BY repo) AS available FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha DESC) AS rn FROM cm)
      WHERE rn <= 7)
WHERE available >= 7 AND rn - 1 > 0 AND (rn - 1) % 2 = 0""")

register("p9_snapshot_ids", with_(COMMITS) + f"""
SELECT repo, sha, replace({ISO.format('ts')}, ':', '-') || '_' || coalesce(short_sha, 'nogit') AS snapshot_id,
       short_sha || CASE WHEN subject = 'fix' THEN '*' ELSE '' END AS commit_label
FROM cm""")


# ---- dependency graph over part sequences ---------------------------------------------
MONTHLY = r"""
mon AS (SELECT 'tpch' AS repo, strftime(o_orderdate, '%Y-%m') AS snapshot_id,
               (year(o_orderdate) * 12 + month(o_orderdate)) * 17592186044416 AS base, l.*
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""
GRAPH = MONTHLY + r""",
e AS (
  SELECT DISTINCT base + l_partkey AS src, base + nxt AS dst FROM (
    SELECT base, l_partkey,
           lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt
    FROM mon)
  WHERE nxt IS NOT NULL),
m AS (SELECT DISTINCT repo, snapshot_id, base + p_partkey AS node,
             'src/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, p_size AS size
      FROM mon JOIN part ON l_partkey = p_partkey),
ep AS (SELECT ms.repo, ms.snapshot_id, e.src, e.dst, ms.path AS src_path, md.path AS dst_path
       FROM e JOIN m ms ON e.src = ms.node JOIN m md ON e.dst = md.node),
cp AS (
  SELECT m.repo, m.snapshot_id, m.node, m.path, coalesce(o.dependencies, 0) AS dependencies,
         coalesce(i.dependents, 0) AS dependents,
         CASE WHEN coalesce(o.dependencies, 0) + coalesce(i.dependents, 0) > 0
              THEN coalesce(o.dependencies, 0) / (coalesce(o.dependencies, 0) + coalesce(i.dependents, 0))
              ELSE 0.0 END AS instability
  FROM m
  LEFT JOIN (SELECT src AS node, count(*) AS dependencies FROM e GROUP BY src) o USING (node)
  LEFT JOIN (SELECT dst AS node, count(*) AS dependents FROM e GROUP BY dst) i USING (node))"""

CLOSURE = r""",
reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src),
circ AS (SELECT ep.* FROM ep WHERE EXISTS (SELECT 1 FROM reach r WHERE r.a = ep.dst AND r.b = ep.src)),
bf AS (
  SELECT cp.*, coalesce(ic.in_cycle, false) AS in_cycle
  FROM cp LEFT JOIN (SELECT DISTINCT src AS node, true AS in_cycle FROM circ) ic USING (node))"""


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


register("g2_coupling", with_(GRAPH) + """
SELECT repo, snapshot_id, node, path, dependencies, dependents, instability FROM cp""")

register("g1_circular_edges", with_rec(GRAPH + CLOSURE) + """
SELECT repo, snapshot_id, src, dst, src_path, dst_path FROM circ""")

_BF = "repo, snapshot_id, node, path, dependencies, dependents, instability, in_cycle"
register("a16_instability_by_file", with_rec(GRAPH + CLOSURE) + f"SELECT {_BF} FROM bf")

register("a6_instability_summary", with_rec(GRAPH + CLOSURE) + """
SELECT repo, snapshot_id, count(*) AS total_files, count(*) FILTER (WHERE in_cycle) AS files_in_cycles,
       round(avg(instability), 6) AS average_instability,
       max(dependencies) AS highest_dependencies, max(dependents) AS highest_dependents
FROM bf GROUP BY ALL""")

_RANKED = """
SELECT {bf}, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, snapshot_id ORDER BY {order}, path) AS BIGINT) AS position
  FROM bf {where}) WHERE position <= 25"""
register("t3_highly_unstable", with_rec(GRAPH + CLOSURE) + _RANKED.format(
    bf=_BF, order="instability DESC, dependencies DESC, dependents DESC", where=""))
register("t4_stable_depended_on", with_rec(GRAPH + CLOSURE) + _RANKED.format(
    bf=_BF, order="dependents DESC, instability, dependencies", where="WHERE dependents > 0"))

register("g6_violations", with_rec(GRAPH + CLOSURE) + """
SELECT repo, snapshot_id, 'no-circular' AS rule, 'error' AS severity, src_path AS from_path, dst_path AS to_path
FROM circ""")

register("a9_cycle_counts", with_rec(GRAPH + CLOSURE) + """
SELECT repo, snapshot_id, path, count(*) AS cycles FROM (
  SELECT repo, snapshot_id, unnest([a, b]) AS path FROM (
    SELECT DISTINCT repo, snapshot_id, least(src_path, dst_path) AS a, greatest(src_path, dst_path) AS b FROM circ))
GROUP BY ALL""")

register("a5_cycle_metrics", with_rec(GRAPH + CLOSURE) + """
, x AS (
  SELECT repo, snapshot_id, 1 AS m, 0 AS d, 0 AS c, 0 AS v FROM m
  UNION ALL SELECT repo, snapshot_id, 0, 1, 0, 0 FROM ep
  UNION ALL SELECT repo, snapshot_id, 0, 0, 1, CASE WHEN starts_with(src_path, 'src/Brand#1') THEN 1 ELSE 0 END
  FROM circ)
SELECT repo, snapshot_id, CAST(sum(m) AS BIGINT) AS total_modules, CAST(sum(d) AS BIGINT) AS total_dependencies,
       CAST(sum(c) AS BIGINT) AS circular_edges, CAST(sum(v) AS BIGINT) AS violations,
       CAST(CASE WHEN sum(v) > 0 THEN sum(v) ELSE sum(c) END AS BIGINT) AS cycle_count
FROM x GROUP BY ALL""")

REACH = r""",
rch(node) AS (SELECT node FROM m WHERE size <= 5
              UNION SELECT e.dst FROM rch JOIN e ON e.src = rch.node)"""

register("g7_reachable", with_rec(GRAPH + REACH) + """
SELECT node FROM rch""")

register("c10_unused_files", with_rec(GRAPH + REACH) + """
SELECT repo, snapshot_id, node, path FROM m WHERE node NOT IN (SELECT node FROM rch)""")

register("g3_scope", with_(GRAPH) + r"""
SELECT repo, snapshot_id, src_path, dst_path FROM ep
WHERE regexp_matches(src_path, '^src/Brand#1[0-9]?/') AND regexp_matches(dst_path, '^src/Brand#1[0-9]?/')""")

register("g4_layers", with_(GRAPH) + r"""
SELECT repo, snapshot_id, src_layer, dst_layer, count(*) AS weight FROM (
  SELECT repo, snapshot_id, coalesce(nullif(regexp_extract(src_path, '^src/[^/]+/', 0), ''), src_path) AS src_layer,
         coalesce(nullif(regexp_extract(dst_path, '^src/[^/]+/', 0), ''), dst_path) AS dst_layer
  FROM ep) WHERE src_layer <> dst_layer GROUP BY ALL""")

register("g5_focus", with_(GRAPH) + r"""
SELECT repo, snapshot_id, src_path, dst_path FROM ep
WHERE regexp_matches(src_path, '^src/Brand#7/') OR regexp_matches(dst_path, '^src/Brand#7/')""")

register("p4_filtered_edges", with_(GRAPH) + r"""
SELECT repo, snapshot_id, src_path, dst_path FROM ep
WHERE regexp_matches(src_path, '^src') AND regexp_matches(dst_path, '^src')
  AND NOT (regexp_matches(src_path, '^src/Brand#5/') OR regexp_matches(dst_path, '^src/Brand#5/'))
  AND NOT regexp_matches(src_path, '^src/Brand#4/')""")

register("g8_rule_violations", with_(GRAPH) + r"""
SELECT repo, snapshot_id, 'same-manufacturer' AS rule, src_path, dst_path FROM ep
WHERE regexp_matches(src_path, '^src/Brand#\d')
  AND NOT (starts_with(dst_path, regexp_extract(src_path, '^src/Brand#\d', 0))
           AND regexp_matches(dst_path, '^src/Brand#\d(\d|/)'))""")

RULE_SET = r"""
, flagged AS (SELECT ep.*, circ.src IS NOT NULL AS circular FROM ep LEFT JOIN circ USING (src, dst)),
broken AS (
  SELECT repo, snapshot_id, 'same-manufacturer' AS rule, 'warn' AS severity, src_path, dst_path FROM flagged
  WHERE regexp_matches(src_path, '^src/Brand#\d') AND regexp_matches(dst_path, '^src/Brand#[1-4]')
    AND NOT (starts_with(dst_path, regexp_extract(src_path, '^src/Brand#\d', 0))
             AND regexp_matches(dst_path, '^src/Brand#\d(\d|/)'))
  UNION ALL
  SELECT repo, snapshot_id, 'generic-stays-generic', 'error', src_path, dst_path FROM flagged
  WHERE starts_with(src_path, 'src/Brand#5') AND starts_with(dst_path, 'src/Brand#1')
  UNION ALL
  SELECT repo, snapshot_id, 'no-circular', 'error', src_path, dst_path FROM flagged WHERE circular
  UNION ALL
  SELECT repo, snapshot_id, 'same-end', 'info', src_path, dst_path FROM flagged
  WHERE right(src_path, 1) = right(dst_path, 1) AND NOT regexp_matches(dst_path, '^src/Brand#[24]'))
"""

register("g8_rule_set", with_rec(GRAPH + CLOSURE) + RULE_SET + "SELECT * FROM broken")

register("g8_rule_summary", with_rec(GRAPH + CLOSURE) + RULE_SET + """
SELECT repo, snapshot_id, count(*) FILTER (WHERE severity = 'error') AS error,
       count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info,
       count(*) FILTER (WHERE severity = 'error') = 0 AS passes
FROM (SELECT DISTINCT repo, snapshot_id FROM m) LEFT JOIN broken USING (repo, snapshot_id) GROUP BY ALL""")

register("g9_more_unstable", with_(GRAPH) + """
SELECT ep.repo, ep.snapshot_id, ep.src_path, ep.dst_path, s.instability AS src_i, d.instability AS dst_i
FROM ep JOIN cp s ON ep.src = s.node JOIN cp d ON ep.dst = d.node
WHERE d.instability > s.instability""")


# ---- unused code over symbol / package / link adapters ------------------------------------
_SYMBOLS = r"""
xr AS (
  SELECT repo, snapshot_id, 'src/supp/' || CAST(l.l_suppkey AS VARCHAR) AS file,
         'p' || CAST(l.l_partkey AS VARCHAR) AS symbol, p_size,
         CASE split_part(p.p_type, ' ', 1) WHEN 'STANDARD' THEN 'exports' WHEN 'SMALL' THEN 'types'
              WHEN 'MEDIUM' THEN 'classMembers' WHEN 'LARGE' THEN 'nsExports' WHEN 'ECONOMY' THEN 'enumMembers'
              WHEN 'PROMO' THEN 'nsTypes' ELSE 'exports' END AS kind,
         l_returnflag = 'R' AND l_quantity <= 10 AS imported
  FROM mon l JOIN part p ON l.l_partkey = p.p_partkey),
ux AS (SELECT repo, snapshot_id, file, symbol, kind FROM (
         SELECT *, bool_or(imported) OVER (PARTITION BY repo, snapshot_id, file, symbol) AS used_,
                bool_or(p_size = 1) OVER (PARTITION BY repo, snapshot_id, file) AS entry_ FROM xr)
       WHERE NOT used_ AND NOT entry_ GROUP BY ALL),
dx AS (SELECT repo, snapshot_id, file, symbol, count(*) AS copies FROM xr
       GROUP BY repo, snapshot_id, file, symbol HAVING count(*) > 1),
decl AS (SELECT DISTINCT 'tpch' AS repo, strftime(l_shipdate, '%Y-%m') AS snapshot_id,
                'pkg-' || CAST(p_partkey AS VARCHAR) AS package,
                CASE WHEN p_size >= 45 THEN 'devDependencies' ELSE 'dependencies' END AS kind
         FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 26),
used AS (SELECT DISTINCT repo, snapshot_id, 'pkg-' || CAST(l_partkey AS VARCHAR) AS package,
                'src/supp/' || CAST(l_suppkey AS VARCHAR) AS file
         FROM mon),
ud AS (SELECT * FROM decl d WHERE NOT EXISTS (
         SELECT 1 FROM used u WHERE u.snapshot_id = d.snapshot_id AND u.package = d.package)),
ul AS (SELECT repo, snapshot_id, file, package FROM used u WHERE NOT EXISTS (
         SELECT 1 FROM decl d WHERE u.snapshot_id = d.snapshot_id AND u.package = d.package)),
pg AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS repo, url, html,
              regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS target FROM pages),
links AS (SELECT DISTINCT repo, url AS file, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS specifier
          FROM pg),
ur AS (SELECT repo, 'crawl' AS snapshot_id, file, specifier FROM links l WHERE NOT EXISTS (
         SELECT 1 FROM pg WHERE pg.repo = l.repo AND pg.target = l.specifier))"""
SYMBOLS = MONTHLY + "," + _SYMBOLS

ISSUES = "," + _SYMBOLS + r""",
iss AS (
  SELECT repo, snapshot_id, path AS file, 'files' AS kind, path AS name FROM m
  WHERE node NOT IN (SELECT node FROM rch)
  UNION ALL SELECT repo, snapshot_id, file, kind, symbol FROM ux
  UNION ALL SELECT repo, snapshot_id, file, 'duplicates', symbol FROM dx
  UNION ALL SELECT repo, snapshot_id, 'package.json', kind, package FROM ud
  UNION ALL SELECT repo, snapshot_id, file, 'unlisted', package FROM ul
  UNION ALL SELECT repo, snapshot_id, file, 'unresolved', specifier FROM ur)"""

register("c11_unused_exports", with_(SYMBOLS) + "SELECT repo, snapshot_id, file, symbol, kind FROM ux")
register("c15_duplicate_exports", with_(SYMBOLS) + "SELECT repo, snapshot_id, file, symbol, copies FROM dx")
register("c12_unused_dependencies", with_(SYMBOLS) + "SELECT repo, snapshot_id, package, kind FROM ud")
register("c13_unlisted_dependencies", with_(SYMBOLS) + "SELECT repo, snapshot_id, file, package FROM ul")
register("c14_unresolved_imports", with_(SYMBOLS) + "SELECT repo, snapshot_id, file, specifier FROM ur")

WORKSPACES = r"""
nt AS (SELECT n_nationkey, 'packages/r' || CAST(n_regionkey AS VARCHAR) AS r,
              'packages/r' || CAST(n_regionkey AS VARCHAR) || '/n' || CAST(n_nationkey AS VARCHAR) AS n FROM nation),
wm AS (SELECT '.' AS folder UNION SELECT r FROM nt UNION SELECT n FROM nt WHERE n_nationkey % 2 = 0),
wu0 AS (SELECT DISTINCT n || '/' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 7 = 0 THEN '.test.ts' ELSE '.ts' END
               AS file, {package} AS package
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nt ON s_nationkey = n_nationkey),
wu AS (SELECT * FROM wu0 WHERE {files}),
wd0 AS (SELECT p_partkey AS l_partkey, CASE WHEN p_size >= 45 THEN 'devDependencies' ELSE 'dependencies' END AS kind FROM part),
wd AS (SELECT manifest, {package} AS package, kind FROM (
         SELECT '.' AS manifest, * FROM wd0 WHERE l_partkey % 3 = 0
         UNION ALL SELECT 'packages/r' || CAST(l_partkey % 5 AS VARCHAR), * FROM wd0 WHERE l_partkey % 2 = 0
         UNION ALL SELECT n, wd0.* FROM wd0 JOIN nt ON l_partkey % 25 = n_nationkey WHERE n_nationkey % 2 = 0)
       WHERE {kinds}),
wf AS (SELECT DISTINCT file FROM wu),
wo0 AS (SELECT file, folder, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN folder = '.' THEN 0 ELSE length(folder) END
               DESC) AS nearest
        FROM wf JOIN wm ON folder = '.' OR starts_with(file, folder || '/')),
wo AS (SELECT wu.file, folder, package FROM wu JOIN wo0 USING (file) WHERE {owners}),
wi AS (
  SELECT CASE WHEN manifest = '.' THEN '' ELSE manifest || '/' END || 'package.json' AS file, kind, package AS name
  FROM wd WHERE NOT EXISTS (SELECT 1 FROM wo WHERE wo.folder = manifest AND wo.package = wd.package)
  UNION ALL
  SELECT file, 'unlisted', package FROM wu
  WHERE NOT EXISTS (SELECT 1 FROM wo JOIN wd ON wo.folder = wd.manifest AND wo.package = wd.package
                    WHERE wo.file = wu.file AND wo.package = wu.package))"""
for _name, _files, _kinds, _owners, _where in (
        ("p5_workspace_issues", "true", "true", "true", "true"),
        ("p5_strict_issues", "file NOT LIKE '%.test.%'", "kind = 'dependencies'", "nearest = 1", "true"),
        ("p5_one_workspace", "true", "true", "true", "starts_with(file, 'packages/r1/')")):
    register(_name, with_(WORKSPACES.format(package="'pkg-' || CAST(l_partkey AS VARCHAR)", files=_files, kinds=_kinds, owners=_owners)) + f"""
SELECT 'workspaces' AS repo, 'all' AS snapshot_id, file, kind, name FROM wi WHERE {_where}""")

MANIFESTS = WORKSPACES.format(package="'pkg-' || CAST(l_partkey AS VARCHAR)", files="true", kinds="true", owners="true") + r""",
mp AS (SELECT 'pkg-' || CAST(p_partkey AS VARCHAR) AS package, p_partkey, p_size,
              'bin-' || CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey % 40 AS VARCHAR) AS cmd FROM part),
md AS (SELECT manifest, wd.package, CASE WHEN p_size <= 5 THEN 'optionalPeerDependencies' ELSE kind END AS kind,
              CASE WHEN p_partkey % 21 = 0 THEN 'old' WHEN p_partkey % 2 = 0 THEN 'default' END AS cat
       FROM wd JOIN mp ON wd.package = mp.package),
mo AS (SELECT manifest, package, kind FROM md WHERE kind <> 'optionalPeerDependencies'),
mh AS (SELECT DISTINCT manifest, mo.package, cmd FROM mo JOIN mp ON mo.package = mp.package),
ms AS (SELECT DISTINCT nt.n AS manifest, cmd
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nt ON s_nationkey = n_nationkey JOIN mp ON l_partkey = p_partkey
       WHERE l_returnflag = 'A' AND n_nationkey % 2 = 0),
mso AS (SELECT ms.manifest AS caller, cmd, folder FROM ms JOIN wm ON folder = '.' OR starts_with(ms.manifest || '/', folder || '/')),
mi AS (
  SELECT DISTINCT CASE WHEN manifest = '.' THEN '' ELSE manifest || '/' END || 'package.json' AS file, kind, package AS name FROM mo
  WHERE NOT EXISTS (SELECT 1 FROM wo WHERE wo.folder = mo.manifest AND wo.package = mo.package)
    AND NOT EXISTS (SELECT 1 FROM mso JOIN mh ON mh.cmd = mso.cmd AND mh.manifest = mso.folder
                    WHERE mh.manifest = mo.manifest AND mh.package = mo.package)
  UNION ALL
  SELECT file, CASE WHEN EXISTS (SELECT 1 FROM wo JOIN md ON wo.folder = md.manifest AND wo.package = md.package
                                 WHERE wo.file = wu.file AND wo.package = wu.package)
               THEN 'optionalPeerDependencies' ELSE 'unlisted' END, package FROM wu
  WHERE NOT EXISTS (SELECT 1 FROM wo JOIN mo ON wo.folder = mo.manifest AND wo.package = mo.package
                    WHERE wo.file = wu.file AND wo.package = wu.package)
  UNION ALL
  SELECT manifest || '/package.json', 'binaries', cmd FROM ms
  WHERE NOT EXISTS (SELECT 1 FROM mso JOIN mh ON mh.cmd = mso.cmd AND mh.manifest = mso.folder
                    WHERE mso.caller = ms.manifest AND mso.cmd = ms.cmd)
  UNION ALL
  SELECT 'package.json', 'catalog', cat || '.' || package FROM (
    SELECT 'default' AS cat, package FROM mp WHERE p_partkey % 5 = 0 UNION ALL SELECT 'old', package FROM mp WHERE p_partkey % 7 = 0) e
  WHERE NOT EXISTS (SELECT 1 FROM md WHERE md.cat = e.cat AND md.package = e.package))"""
register("c12_manifest_issues", with_(MANIFESTS) + "SELECT 'workspaces' AS repo, 'all' AS snapshot_id, file, kind, name FROM mi")
register("a3_manifest_metrics", with_(MANIFESTS) + """
SELECT 'workspaces' AS repo, 'all' AS snapshot_id, count(*) FILTER (WHERE kind = 'files') AS unused_files,
       CAST(0 AS BIGINT) AS unused_exports, CAST(0 AS BIGINT) AS unused_types,
       count(*) AS unused_dependencies, count(*) AS total_issues FROM mi""")

register("a3_unused_metrics", with_rec(GRAPH + REACH + ISSUES) + """
SELECT repo, snapshot_id, count(*) FILTER (WHERE kind = 'files') AS unused_files,
       count(*) FILTER (WHERE kind IN ('exports', 'nsExports', 'classMembers', 'enumMembers')) AS unused_exports,
       count(*) FILTER (WHERE kind IN ('types', 'nsTypes')) AS unused_types,
       count(*) FILTER (WHERE kind IN ('dependencies', 'devDependencies', 'optionalPeerDependencies', 'unlisted',
                                       'binaries', 'unresolved', 'catalog')) AS unused_dependencies,
       count(*) AS total_issues
FROM iss GROUP BY repo, snapshot_id""")

register("a7_unused_by_file", with_rec(GRAPH + REACH + ISSUES) + """
SELECT repo, snapshot_id, file, count(*) AS unused FROM iss WHERE file IS NOT NULL AND file <> '' GROUP BY ALL""")

register("p5_filtered_issues", with_rec(GRAPH + REACH + ISSUES) + """
SELECT repo, snapshot_id, file, kind, name FROM iss
WHERE kind IN ('exports', 'types', 'files', 'unresolved') AND kind NOT IN ('unresolved')
  AND starts_with(file, 'src/')""")

# ---- churn over orders / lineitem ---------------------------------------------------------
CHURN = r"""
cmt AS (SELECT 'repo-' || CAST(o_custkey AS VARCHAR) AS repo, o_orderkey AS sha, o_orderdate AS ts,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'fix' ELSE 'feat' END AS subject FROM orders),
tch AS (SELECT l.l_orderkey AS sha, 'src/' || p.p_brand || '/' || CAST(l.l_partkey AS VARCHAR) AS file,
               CAST(l.l_quantity AS BIGINT) AS lines, p_size AS size
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
rc AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY repo) AS newest FROM cmt)
       WHERE ts >= newest - INTERVAL 90 DAYS),
ch AS (SELECT repo, file, count(DISTINCT sha) AS commits,
              count(DISTINCT CASE WHEN regexp_matches(subject, '^fix') THEN sha END) AS fix_commits,
              CAST(sum(lines) AS BIGINT) AS lines_touched, min(size) AS size
       FROM tch JOIN rc USING (sha) GROUP BY repo, file),
mc AS (SELECT repo, file, strftime(ts, '%Y-%m') AS month, count(DISTINCT sha) AS commits
       FROM tch JOIN cmt USING (sha) GROUP BY ALL)"""

register("c17_churn", with_(CHURN) + "SELECT repo, file, commits, fix_commits, lines_touched FROM ch")
register("c17_monthly_churn", with_(CHURN) + "SELECT repo, file, month, commits FROM mc")
register("c18_churn_hotspots", with_(CHURN) + """
, t AS (SELECT *, count(*) OVER w AS n, sum(commits) OVER w AS sum_commits, sum(size) OVER w AS sum_size
        FROM ch WINDOW w AS (PARTITION BY repo))
SELECT * FROM (
  SELECT repo, file, commits, CAST(size AS BIGINT) AS size, CAST(commits * size AS BIGINT) AS score,
         CASE WHEN commits * n >= sum_commits AND size * n >= sum_size THEN 'hotspot'
              WHEN commits * n >= sum_commits THEN 'churning'
              WHEN size * n >= sum_size THEN 'large' ELSE 'calm' END AS quadrant,
         CAST(row_number() OVER (PARTITION BY repo ORDER BY commits * size DESC, file) AS BIGINT) AS position
  FROM t) WHERE position <= 20""")
register("c18_recurring_hotspots", with_(CHURN) + """
, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, month ORDER BY commits DESC, file) AS rk FROM mc)
        WHERE rk <= 20)
SELECT a.repo, a.file, a.month, b.month AS next_month FROM r a JOIN r b
  ON a.repo = b.repo AND a.file = b.file
  AND strftime(CAST(a.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') = b.month""")


# ---- clones over the corpus ------------------------------------------------------------------
CLONES = SOURCE_FILES + r""",
raw AS (
  SELECT repo, snapshot_id, path, unnest(generate_series(1, len(ls))) AS ln, unnest(ls) AS line
  FROM (SELECT repo, snapshot_id, path, string_split(content, chr(10)) AS ls FROM sf)),
nl AS (
  SELECT repo, snapshot_id, path, ln, t,
         len(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^ \t\n\f\r\p{L}\p{N}_]')) AS tok,
         row_number() OVER (PARTITION BY repo, snapshot_id, path ORDER BY ln) AS pos
  FROM (SELECT *, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS t FROM raw) WHERE t <> ''),
sh AS (
  SELECT * FROM (
    SELECT repo, snapshot_id, path, pos, ln AS start_ln, lead(ln, 4) OVER w AS end_ln, tok AS tok_first,
           tok + lead(tok, 1) OVER w + lead(tok, 2) OVER w + lead(tok, 3) OVER w + lead(tok, 4) OVER w
             AS tok_window,
           t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w || chr(10) || lead(t, 3) OVER w
             || chr(10) || lead(t, 4) OVER w AS txt
    FROM nl WINDOW w AS (PARTITION BY repo, snapshot_id, path ORDER BY pos))
  WHERE end_ln IS NOT NULL),
same AS (  -- all pairs of places that share a window, joined to runs along their diagonals
  SELECT a.repo, a.snapshot_id, a.path AS f, b.path AS s, a.pos AS fpos, b.pos AS spos,
         a.pos - row_number() OVER (PARTITION BY a.repo, a.snapshot_id, a.path, b.path, b.pos - a.pos ORDER BY a.pos) AS grp
  FROM sh a JOIN sh b ON a.repo = b.repo AND a.snapshot_id = b.snapshot_id AND a.txt = b.txt AND (a.path, a.pos) <> (b.path, b.pos)),
pr AS (SELECT repo, snapshot_id, f, s, min(fpos) AS fpos, min(spos) AS spos, count(*) + 4 AS n FROM same GROUP BY repo, snapshot_id, f, s, spos - fpos, grp),
held AS (  -- every run's text, as one place and a length, with all places that hold it
  SELECT DISTINCT t.repo, t.snapshot_id, t.f, t.fpos, t.n, p.s AS path, p.spos + t.fpos - p.fpos AS pos
  FROM (SELECT DISTINCT repo, snapshot_id, f, fpos, n FROM pr) t
  JOIN pr p ON p.repo = t.repo AND p.snapshot_id = t.snapshot_id AND p.f = t.f AND t.fpos >= p.fpos AND p.n - (t.fpos - p.fpos) >= t.n
  UNION SELECT repo, snapshot_id, f, fpos, n, f, fpos FROM pr),
named AS (
  SELECT *, min({'path': path, 'pos': pos}) OVER (PARTITION BY repo, snapshot_id, f, fpos, n) AS rep FROM held),
members AS (
  SELECT DISTINCT m.repo, m.snapshot_id, m.rep, m.n, m.path, m.pos, b.t AS before,
         coalesce('=' || z.t, m.path || ':' || m.pos) AS behind
  FROM named m
  LEFT JOIN nl b ON b.repo = m.repo AND b.snapshot_id = m.snapshot_id AND b.path = m.path AND b.pos = m.pos - 1
  LEFT JOIN nl z ON z.repo = m.repo AND z.snapshot_id = m.snapshot_id AND z.path = m.path AND z.pos = m.pos + m.n),
branches AS (
  SELECT repo, snapshot_id, rep, n, min({'path': path, 'pos': pos}) AS place, arg_min({'t': before}, {'path': path, 'pos': pos}) AS left_,
         count(*) AS copies
  FROM members GROUP BY repo, snapshot_id, rep, n, behind),
links AS (
  SELECT u.repo, u.snapshot_id, u.n, u.rep.path AS first_file, u.rep.pos AS first_pos, u.place.path AS second_file, u.place.pos AS start_pos,
         (SELECT sum(copies) FROM branches x WHERE x.repo = u.repo AND x.snapshot_id = u.snapshot_id AND x.rep = u.rep AND x.n = u.n) AS places
  FROM branches u JOIN branches r ON r.repo = u.repo AND r.snapshot_id = u.snapshot_id AND r.rep = u.rep AND r.n = u.n AND r.place = r.rep
  WHERE u.place <> u.rep AND (u.left_.t IS NULL OR r.left_.t IS NULL OR u.left_.t <> r.left_.t)),
alls AS (
  SELECT l.repo, l.snapshot_id, l.first_file, l.second_file, l.start_pos, l.start_pos + l.n - 1 AS end_pos, l.places,
         min(a.ln) AS first_start, max(a.ln) AS first_end, min(b.ln) AS second_start, max(b.ln) AS second_end, sum(b.tok) AS tokens
  FROM links l
  JOIN nl b ON b.repo = l.repo AND b.snapshot_id = l.snapshot_id AND b.path = l.second_file AND b.pos BETWEEN l.start_pos AND l.start_pos + l.n - 1
  JOIN nl a ON a.repo = l.repo AND a.snapshot_id = l.snapshot_id AND a.path = l.first_file AND a.pos = l.first_pos + b.pos - l.start_pos
  GROUP BY ALL HAVING sum(b.tok) >= 50),
runs AS (
  SELECT * FROM alls r
  WHERE NOT EXISTS (
    SELECT 1 FROM alls o
    WHERE o.repo = r.repo AND o.snapshot_id = r.snapshot_id AND o.second_file = r.second_file
      AND o.start_pos <= r.start_pos AND o.end_pos >= r.end_pos
      AND (o.start_pos < r.start_pos OR o.end_pos > r.end_pos
           OR (o.first_file, o.first_start) < (r.first_file, r.first_start)))),
cl AS (
  SELECT repo, snapshot_id, first_file, CAST(first_start AS BIGINT) AS first_start,
         CAST(first_end AS BIGINT) AS first_end, second_file, CAST(second_start AS BIGINT) AS second_start,
         CAST(second_end AS BIGINT) AS second_end, CAST(second_end - second_start + 1 AS BIGINT) AS lines,
         CAST(end_pos - start_pos + 1 AS BIGINT) AS norm_lines, CAST(tokens AS BIGINT) AS tokens
  FROM runs)"""

register("c5_clones", with_(CLONES) + "SELECT * FROM cl")

register("c5_clone_classes", with_(CLONES) + """
SELECT DISTINCT repo, snapshot_id, first_file, CAST(first_start AS BIGINT) AS first_start, CAST(first_end AS BIGINT) AS first_end,
       CAST(end_pos - start_pos + 1 AS BIGINT) AS norm_lines, CAST(tokens AS BIGINT) AS tokens, CAST(places AS BIGINT) AS places
FROM alls""")

register("c7_cross_folder_clones", with_(CLONES) + """
SELECT * FROM cl
WHERE regexp_replace(first_file, '/[^/]*$', '') <> regexp_replace(second_file, '/[^/]*$', '')""")

register("a8_clone_counts", with_(CLONES) + """
SELECT repo, snapshot_id, path, count(*) AS duplication FROM (
  SELECT repo, snapshot_id, unnest([first_file, second_file]) AS path FROM cl) GROUP BY ALL""")

register("j3_clones_by_file", with_(CLONES) + """
SELECT repo, snapshot_id, lines, first_file AS path, first_start AS self_start, first_end AS self_end,
       second_file AS other_path, second_start AS other_start, second_end AS other_end FROM cl
UNION ALL
SELECT repo, snapshot_id, lines, second_file, second_start, second_end, first_file, first_start, first_end FROM cl
WHERE second_file <> first_file""")

register("a4_duplication_totals", with_(CLONES) + """
, tl AS (SELECT repo, snapshot_id, sum(len(string_split(content, chr(10)))) AS total_lines FROM sf GROUP BY ALL),
tt AS (SELECT repo, snapshot_id, sum(tok) AS total_tokens FROM nl GROUP BY ALL),
dl AS (SELECT DISTINCT repo, snapshot_id, second_file AS path, unnest(generate_series(second_start, second_end)) AS ln
       FROM cl),
c AS (SELECT repo, snapshot_id, count(*) AS clones FROM cl GROUP BY ALL),
dd AS (SELECT dl.repo, dl.snapshot_id, count(*) AS dup_lines, sum(tok) AS dup_tokens
       FROM dl LEFT JOIN nl USING (repo, snapshot_id, path, ln) GROUP BY ALL),
j AS (SELECT tl.repo, tl.snapshot_id, total_lines, total_tokens, coalesce(clones, 0) AS clones,
             coalesce(dup_lines, 0) AS dup_lines, coalesce(dup_tokens, 0) AS dup_tokens
      FROM tl JOIN tt USING (repo, snapshot_id) LEFT JOIN c USING (repo, snapshot_id)
       LEFT JOIN dd USING (repo, snapshot_id))
SELECT repo, snapshot_id, CAST(clones AS BIGINT) AS clones,
       CAST((10000 * dup_lines + total_lines // 2) // greatest(total_lines, 1) AS DOUBLE) / 100
         AS duplicated_lines_percent,
       CAST((10000 * dup_tokens + total_tokens // 2) // greatest(total_tokens, 1) AS DOUBLE) / 100
         AS duplicated_tokens_percent,
       CAST(total_lines AS BIGINT) AS total_lines
FROM j""")


# ---- details and dashboard rows ----------------------------------------------------------------
# fixed values: the label of each issue kind
_LABELS = """
lbl(kind, kind_label) AS (VALUES
  ('files', 'Entire file unused'), ('dependencies', 'Unused dependency'),
  ('devDependencies', 'Unused devDependency'), ('unlisted', 'Unlisted dependency'),
  ('unresolved', 'Unresolved import'), ('exports', 'Unused export'), ('nsExports', 'Unused namespace export'),
  ('classMembers', 'Unused class member'), ('types', 'Unused type'), ('nsTypes', 'Unused namespace type'),
  ('enumMembers', 'Unused enum member'), ('duplicates', 'Duplicate entry'))"""

register("j4_unused_items", with_rec(GRAPH + REACH + ISSUES + "," + _LABELS) + """
SELECT DISTINCT repo, snapshot_id, file,
       CASE WHEN kind = 'files' THEN kind_label ELSE kind_label || ': ' || coalesce(name, '?') END AS label
FROM iss JOIN lbl USING (kind)""")

register("s14_dashboard_rows", """
SELECT h.repo, h.snapshot_id, """ + ISO.format("h.ts") + """ AS timestamp,
       strftime(h.ts, '%a, %b ') || CAST(day(h.ts) AS VARCHAR) ||
         CASE WHEN day(h.ts) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN day(h.ts) % 10 = 1 THEN 'st'
              WHEN day(h.ts) % 10 = 2 THEN 'nd' WHEN day(h.ts) % 10 = 3 THEN 'rd' ELSE 'th' END
         || ' ' || CAST(year(h.ts) AS VARCHAR) AS label,
       m.total_lines AS lines, m.total_complexity AS complexity, m.total_issues AS unused,
       m.duplicated_lines_percent AS duplication, m.cycle_count AS cycles,
       n.node_count, n.root_id, h.overall, h.trend
FROM (""" + ORACLE["a14_health_trend"] + """) h
JOIN (""" + with_(SNAPSHOT_METRICS) + "SELECT * FROM sm" + """) m USING (repo, snapshot_id)
JOIN (""" + ORACLE["a12_node_counts"] + """) n USING (repo, snapshot_id)""")


# ---- report round trips (same numbers as the direct queries) -------------------------------------
register("s6_report_file_stats", with_(LINE_STATS) + """
SELECT repo, snapshot_id, path, language, lines, code, complexity FROM st""")
register("s7_unused_report_metrics", ORACLE["a3_unused_metrics"])
register("s8_clone_report_counts", ORACLE["a8_clone_counts"])
register("s9_graph_report_cycle_counts", ORACLE["a9_cycle_counts"])


# C8 strict mode: raw lines, blank lines kept
CLONES_STRICT = CLONES.replace("  FROM (SELECT *, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS t FROM raw) WHERE t <> ''),", '  FROM (SELECT *, line AS t FROM raw)),')
assert CLONES_STRICT != CLONES
register("c8_clones_strict", with_(CLONES_STRICT) + "SELECT * FROM cl")

# C8 weak mode: trimmed, blank and comment lines dropped
CLONES_WEAK = CLONES.replace(
    "FROM (SELECT *, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS t FROM raw) WHERE t <> ''),",
    "FROM (SELECT *, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS t FROM raw)"
    " WHERE t <> '' AND NOT regexp_matches(t, '^(//|#|/\\*|\\*|--)')),")
assert CLONES_WEAK != CLONES
register("c8_clones_weak", with_(CLONES_WEAK) + "SELECT * FROM cl")

# ---- snapshot store round trip -----------------------------------------------------------------
register("s1_stored_trend", with_(CHECKS) + "SELECT repo, snapshot_id, lines, complexity, unused, duplication, cycles FROM tv")

register("s2_latest_snapshot", with_(CHECKS) + """
SELECT repo, snapshot_id, count(*) AS checks FROM fm
WHERE (repo, snapshot_id) IN (SELECT (repo, max(snapshot_id)) FROM fm GROUP BY repo) GROUP BY repo, snapshot_id""")

register("s3_bundles", with_(CHECKS) + """
SELECT repo, snapshot_id, '# ' || snapshot_id AS report_text, 'src' AS root_id,
       CAST(sum(count_value) AS BIGINT) AS counted
FROM fm GROUP BY repo, snapshot_id""")

register("s5_retained_snapshots", with_(CHECKS) + """
SELECT repo, snapshot_id, row_number() OVER (PARTITION BY repo ORDER BY snapshot_id DESC) <= 10 AS kept
FROM (SELECT DISTINCT repo, snapshot_id FROM fm)""")

# ---- annotated sources -----------------------------------------------------------------------
ANNOTATED = r"""
sf AS (
  SELECT lang AS repo, 'annotated' AS snapshot_id,
         'src/' || source || '/' || CAST(doc_id AS VARCHAR) || '.' || ending AS path, ending AS language,
         array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
           CASE WHEN (i - 1 + doc_id) % 3 <> 0 THEN ''
                WHEN i % 2 = 1 OR doc_id % 8 >= 4 THEN '// note' || chr(10) || chr(10)
                ELSE '/* block' || chr(10) || ' still */' || chr(10) || chr(10) END || x), chr(10)) AS content
  FROM (SELECT *, ['ts', 'py', 'sql', 'txt'][doc_id % 4 + 1] AS ending FROM documents))"""

# the block comments are those put in above, so their lines are known by their text
register("c1_annotated_line_stats", with_(ANNOTATED) + r"""
, l AS (SELECT repo, snapshot_id, path, language, unnest(string_split(content, chr(10))) AS x FROM sf),
k AS (SELECT *, regexp_matches(x, '^[ \t\r]*$') AS blank,
             CASE language
               WHEN 'ts' THEN regexp_matches(x, '^[ \t]*//') OR x IN ('/* block', ' still */')
               WHEN 'sql' THEN regexp_matches(x, '^[ \t]*--') OR x IN ('/* block', ' still */')
               WHEN 'py' THEN regexp_matches(x, '^[ \t]*#')
               ELSE regexp_matches(x, '^[ \t]*(//|#|/\*|\*|--)') END AS comment
      FROM l)
SELECT repo, snapshot_id, path, language, count(*) AS lines, count(*) FILTER (WHERE blank) AS blanks,
       count(*) FILTER (WHERE comment AND NOT blank) AS comments,
       count(*) FILTER (WHERE NOT comment AND NOT blank) AS code
FROM k GROUP BY ALL""")

# lines, blanks, comments and code of each inserted piece are known; the document's own lines are code or blank
register("c1_lexed_line_stats", r"""
WITH l AS (
  SELECT lang, doc_id, unnest(string_split(translate(text, '"''`#/\', '      '), chr(10))) AS x,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT lang, doc_id, regexp_matches(x, '^[ \t\r]*$') AS blank,
             CASE WHEN doc_id % 2 = 0 THEN [[1, 0, 0, 1], [3, 0, 1, 2], [1, 0, 1, 0], [3, 0, 0, 3]]
                  ELSE [[1, 0, 0, 1], [3, 0, 0, 3], [1, 0, 1, 0], [1, 1, 0, 0]] END[(i + doc_id) % 4 + 1] AS p
      FROM l)
SELECT lang AS repo, 'src/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.py' END AS path,
       CASE WHEN doc_id % 2 = 0 THEN 'ts' ELSE 'py' END AS language,
       CAST(sum(p[1] + 1) AS BIGINT) AS lines, CAST(sum(p[2] + CAST(blank AS INT)) AS BIGINT) AS blanks,
       CAST(sum(p[3]) AS BIGINT) AS comments, CAST(sum(p[4] + 1 - CAST(blank AS INT)) AS BIGINT) AS code
FROM k GROUP BY lang, doc_id""")

register("c7_annotated_cross_folder", with_(CLONES_WEAK.replace(SOURCE_FILES, ANNOTATED)) + """
SELECT * FROM cl
WHERE regexp_replace(first_file, '/[^/]*$', '') <> regexp_replace(second_file, '/[^/]*$', '')""")

for _name, _clones in (("strict", CLONES_STRICT), ("mild", CLONES), ("weak", CLONES_WEAK)):
    register(f"c8_annotated_{_name}", with_(_clones.replace(SOURCE_FILES, ANNOTATED)) + "SELECT * FROM cl")

register("c9_issue_gate", f"""
SELECT repo, snapshot_id, total_issues, total_issues > 500 AS exceeds_max_issues FROM ({ORACLE["a3_unused_metrics"]})""")
register("c9_duplication_gate", f"""
SELECT repo, snapshot_id, duplicated_lines_percent, duplicated_lines_percent > 1 AS exceeds_threshold
FROM ({ORACLE["a4_duplication_totals"]})""")


def _range(a, b):
    return f"CASE WHEN {a} = {b} THEN 'line ' || CAST({a} AS VARCHAR) ELSE 'lines ' || CAST({a} AS VARCHAR) || '–' || " \
           f"CAST({b} AS VARCHAR) END"


register("f16_clone_lines", f"""
SELECT repo, snapshot_id, first_file, first_start, second_file, {_range('first_start', 'first_end')} AS first_lines,
       {_range('second_start', 'second_end')} AS second_lines FROM ({ORACLE["c5_clones"]})""")
register("f17_report_items", with_rec(GRAPH + REACH + ISSUES) + """
SELECT repo, snapshot_id, file, kind, CASE WHEN kind <> 'files' THEN name END AS name, CAST(NULL AS BIGINT) AS line
FROM iss""")
