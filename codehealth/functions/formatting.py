"""Display expressions (column functions) for history and dashboard tables.

Rounding for display is done in integer tenths of the exact binary value: 0.35
is a little less than 35 hundredths and becomes 0.3, 0.25 is exact and its half
goes up, as the reference's ``toFixed`` does for non-negative values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------
TREND_SEPARATOR = " · "
NO_VALUE = "-"
NO_COMMIT = "nogit"
ANSI_COLOUR = r"\x1B\[[0-9;]*m"
# -----------------------------------------------------------------------------


def _tenths(x: Column) -> Column:
    """Non-negative x rounded to tenths, as BIGINT count of tenths."""
    x = x.cast("double")
    whole = F.floor(x)
    # the fraction in units of 2^-57 is exact from 0.04 up, and below that it rounds to no tenth
    fraction = F.floor((x - whole) * float(1 << 57)).cast("bigint")
    return (whole * 10 + F.shiftright(fraction * 10 + F.lit(1 << 56), 57)).cast("bigint")


def _tenths_text(t: Column) -> Column:
    return F.concat(F.floor(t / 10).cast("bigint").cast("string"), F.lit("."), (t % 10).cast("string"))


def format_number(x: Column) -> Column:
    """integer with thousands separators, NULL -> '-'."""
    return F.coalesce(F.format_number(x.cast("bigint"), 0), F.lit(NO_VALUE))


def format_percent(x: Column) -> Column:
    """one decimal and a percent sign, NULL -> '-'."""
    return F.coalesce(F.concat(_tenths_text(_tenths(x)), F.lit("%")), F.lit(NO_VALUE))


def format_instability(x: Column) -> Column:
    return format_percent(x * 100)


def format_delta(d: Column) -> Column:
    """F8: integer delta -> '=', '+n' or '-n' (thousands separators)."""
    return (F.when(d == 0, F.lit("="))
            .when(d > 0, F.concat(F.lit("+"), F.format_number(d.cast("bigint"), 0)))
            .otherwise(F.concat(F.lit("-"), F.format_number(F.abs(d).cast("bigint"), 0))))


def format_percent_delta(d: Column) -> Column:
    """F8: percent delta with one decimal; rounds to '=' at zero."""
    t = _tenths(F.abs(d))
    return (F.when(t == 0, F.lit("="))
            .otherwise(F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("-")), _tenths_text(t), F.lit("%"))))


def round_half_away(x: Column, decimals: int) -> Column:
    """Round to ``decimals`` with halves away from zero (sign * floor(|x|*10^d + .5))."""
    scale = 10 ** decimals
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale + F.lit(0.0)


def format_duration(ms: Column) -> Column:
    """'<n>ms' under one second, else seconds with one decimal."""
    t = _tenths(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(
        F.concat(_tenths_text(t), F.lit("s")))


def ordinal_day(day: Column) -> Column:
    suffix = (F.when((day % 100 >= 11) & (day % 100 <= 13), F.lit("th"))
              .when(day % 10 == 1, F.lit("st"))
              .when(day % 10 == 2, F.lit("nd"))
              .when(day % 10 == 3, F.lit("rd"))
              .otherwise(F.lit("th")))
    return F.concat(day.cast("string"), suffix)


def human_date(ts: Column) -> Column:
    """'Tue, Mar 10th 2026' (session time zone is UTC)."""
    return F.concat(F.date_format(ts, "EEE, MMM "), ordinal_day(F.dayofmonth(ts)), F.lit(" "),
                    F.year(ts).cast("string"))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 UTC text with milliseconds, as the reference stores it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def snapshot_id(ts_raw: Column, commit: Column) -> Column:
    """Timestamp with ':' replaced by '-', '_' and the commit (or 'nogit')."""
    return F.concat(F.regexp_replace(ts_raw, ":", "-"), F.lit("_"), F.coalesce(commit, F.lit(NO_COMMIT)))


def commit_label(commit: Column, dirty: Column) -> Column:
    """commit, '*' when dirty, 'nogit' when absent."""
    return F.when(commit.isNull(), F.lit(NO_COMMIT)).otherwise(
        F.concat(commit, F.when(F.coalesce(dirty, F.lit(False)), F.lit("*")).otherwise(F.lit(""))))


def status_summary(p: Column, w: Column, f: Column, s: Column) -> Column:
    """'1p/2w/0f/0s'."""
    return F.format_string("%dp/%dw/%df/%ds", p, w, f, s)


def delta_class(metric: str, d: Column) -> Column:
    """neutral for zero, missing or the lines metric; up positive, down negative."""
    if metric == "lines":
        return F.lit("neutral")
    return (F.when(d.isNull() | (d == 0), F.lit("neutral"))
            .when(d > 0, F.lit("positive")).otherwise(F.lit("negative")))


def compact_number(x: Column) -> Column:
    """1.2k, -3.4M (one decimal); below 1,000 at most three decimals; NULL is an em dash."""
    def short(unit: int, sign: str) -> Column:
        return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                        _tenths_text(_tenths(F.abs(x) / unit)), F.lit(sign))
    return (F.when(x.isNull(), F.lit("—"))
            .when(F.abs(x) >= 1_000_000, short(1_000_000, "M"))
            .when(F.abs(x) >= 1_000, short(1_000, "k"))
            .otherwise(F.call_function("format_number", F.round(x.cast("double"), 3), F.lit("#,##0.###"))))


def strip_ansi(s: Column) -> Column:
    """F19."""
    return F.regexp_replace(s, ANSI_COLOUR, "")


def line_range(start: Column, end: Column) -> Column:
    """F16: 'line n' or 'lines a–b'; an unknown start is '?', an unknown end is the start."""
    first = F.coalesce(start.cast("string"), F.lit("?"))
    last = F.coalesce(end.cast("string"), first)
    return (F.when(first == last, F.concat(F.lit("line "), first))
            .otherwise(F.concat(F.lit("lines "), first, F.lit("–"), last)))
