"""Operator parameters with their defaults.

Fixed values that must equal the reference's behaviour are grouped here.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (defaults of the reference's configuration) --------------
DEFAULT_EXTENSIONS = ("ts", "tsx", "js", "jsx")
DEFAULT_TOP = 25
DEFAULT_STATS_EXCLUDE = ("**/mock/", "**/*.test.*")
DEFAULT_CLONE_MODE = "mild"
SNAPSHOT_VERSION = 3
# Clone-detector defaults stated in the reference's documentation.
DEFAULT_MIN_LINES = 5
DEFAULT_MIN_TOKENS = 50
# Health thresholds.
OVERSIZED_CODE_LINES = 350
OVERLY_COMPLEX = 10
# Churn window (days) of the documented churn recipe.
CHURN_DAYS = 90
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class StatsParams:
    top: int = DEFAULT_TOP
    exclude: tuple[str, ...] = DEFAULT_STATS_EXCLUDE
    exclude_dir: tuple[str, ...] = ()
    exclude_ext: tuple[str, ...] = ()
    not_match: str | None = None
    large_line_count: int | None = None
    large_byte_count: int | None = None


@dataclass(frozen=True)
class CloneParams:
    min_lines: int = DEFAULT_MIN_LINES
    min_tokens: int = DEFAULT_MIN_TOKENS
    max_lines: int | None = None
    max_size: int | None = None
    mode: str = DEFAULT_CLONE_MODE  # strict | mild | weak
    formats: tuple[str, ...] = ()  # file extensions, all if empty
    skip_local: bool = False
    threshold: float | None = None
    ignore: tuple[str, ...] = ()
    ignore_pattern: str | None = None


SEVERITIES = ("error", "warn", "info")


@dataclass(frozen=True)
class Rule:
    """One dependency rule; conditions left None are not tested. ``severity`` is one of
    ``SEVERITIES`` or ``ignore``."""
    name: str
    severity: str = "warn"
    from_path: str | None = None
    to_path: str | None = None
    to_path_not: str | None = None
    circular: bool | None = None
