r"""Secret scan: fixed patterns, and a battery of randomness tests for other tokens.

Fixed patterns (base spans): assignments, access keys and long hex runs.

Battery: every other run of 20 or more key characters is a candidate; ``=`` that is
not trailing padding parts it, base spans are cut out of it, and where no encoding holds
the whole of a part, its longest parts within base64 and within base64url count. The
encoding (hex, base32, base62, base64) is inferred from the characters, and the symbols
are tested against a uniform draw from that alphabet: chi-squared uniformity, runs about
the middle symbol, and lag-1 serial correlation. A candidate that a test rejects at
``alpha`` is not random. The rest have two p-values under "ordinary text": of
chi-squared, there noncentral in proportion to length, and of the changes between
letters and digits and from lower to upper case, which names, words and numbers have
few of; Fisher's method joins them. Among ``FAMILY`` candidates that follow each other, a
weighted Benjamini-Hochberg rule with weights in proportion to length holds the
false-discovery rate at ``rate``; what it rejects are spans of kind ``random``. So what
is found of a token does not depend on the length of its document.

Defined cases: a null text counts as empty; an empty text has no spans; texts are read
whole; offsets are code points, ends exclusive; of two random spans, one within the
other, the longer stays; spans that start together stand in the order of ``KINDS``; repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import ship_package

KINDS = ("assign", "access", "hex", "random")

#: The base patterns and the least length of what they catch.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
PART = re.compile(r"[^=]+(?:=+\Z)?")
BY_ALPHABET = (re.compile(r"[A-Za-z0-9+/]{20,}=*"), re.compile(r"[A-Za-z0-9_-]{20,}=*"))
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, alphabet, and the chances that in ordinary text two characters are equal, and that the kind changes
ENCODINGS = (
    ("hex", DIGITS + "abcdef", 0.10, 0.10), ("HEX", DIGITS + "ABCDEF", 0.10, 0.10), ("base32", UPPER + "234567", 0.066, 0.08),
    ("base62", UPPER + LOWER + DIGITS, 0.062, 0.20), ("base64", UPPER + LOWER + DIGITS + "+/", 0.062, 0.20),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 0.062, 0.20),
)
CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")
FAMILY = 10


def _below(z: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _chi2_above(x: float, df: int) -> float:
    """Upper tail of chi-squared (cube-root normal approximation)."""
    if x <= 0:
        return 1.0
    spread = 2 / (9 * df)
    return 1 - _below(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def _binomial_above(x: int, n: int, p: float) -> float:
    """Chance of ``x`` or more in ``n`` draws; beyond 200 draws by the normal approximation."""
    if n > 200:
        return _below((n * p - x + 0.5) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(x, n + 1)))


def _encoding(body: str) -> tuple | None:
    """The first of ``ENCODINGS`` that holds all characters."""
    return next((e for e in ENCODINGS if set(body) <= set(e[1])), None)


def tests(token: str) -> dict | None:
    """Encoding, p-values of the three tests, and the p-value under ordinary text; None if no encoding fits."""
    body = token.rstrip("=")
    n = len(body)
    if n < 2 or not (fits := _encoding(body)):
        return None
    name, alphabet, equal, change = fits
    k = len(alphabet)
    s = np.array([alphabet.index(c) for c in body], dtype=float)
    chi2 = k / n * float((np.bincount(s.astype(int), minlength=k) ** 2).sum()) - n
    high = s >= k / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * ups * downs / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    else:
        p_runs = 0.5 ** (n - 1)
    d = s - s.mean()
    spread = float((d * d).sum())
    p_serial = math.erfc(abs(float((d[1:] * d[:-1]).sum()) / spread * math.sqrt(n)) / math.sqrt(2)) if spread else 0.0
    shift = n * max(k * equal - 1, 0.05)
    p_text = _below((chi2 - (k - 1 + shift)) / math.sqrt(2 * (k - 1 + 2 * shift)))
    both = max(p_text * _binomial_above(len(CHANGE.findall(body)), n - 1, change), 1e-300)
    p_text = both * (1 - math.log(both))  # Fisher's method for two p-values
    return {"encoding": name, "n": n, "uniform": _chi2_above(chi2, k - 1), "runs": p_runs, "serial": p_serial, "text": p_text}


def random_tokens(found: list[dict], alpha: float, rate: float) -> list[int]:
    """Indexes of the candidates of one family that are taken as random.

    What the battery rejects takes part in the false-discovery rule, with p-value 1.
    """
    if not found:
        return []
    mean = sum(t["n"] for t in found) / len(found)
    p = [t["text"] * mean / t["n"] if min(t["uniform"], t["runs"], t["serial"]) >= alpha else math.inf for t in found]
    order = sorted(range(len(p)), key=p.__getitem__)
    taken = max((r for r, i in enumerate(order, 1) if p[i] <= rate * r / len(p)), default=0)
    return sorted(order[:taken])


def _pieces(text: str, start: int, end: int, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places of the tokens to test between ``start`` and ``end``; ``base`` are the spans that overlap this."""
    free, at = [], start
    for a, b in base:
        free.append((at, a))
        at = max(at, b)
    for a, b in [*free, (at, end)]:
        for m in PART.finditer(text[a:b]) if b - a >= LEAST else ():
            if m.end() - m.start() < LEAST:
                continue
            if _encoding(m[0].rstrip("=")):
                yield a + m.start(), a + m.end()
                continue
            for part in sorted((x.start(), x.end()) for one in BY_ALPHABET for x in one.finditer(m[0])):
                yield a + m.start() + part[0], a + m.start() + part[1]


def scan(text: str | None, alpha: float = 0.001, rate: float = 0.01) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start and kind."""
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in spans)
    at, open_, found, places = 0, [], [], []  # open_: base spans that may overlap the candidate
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            open_.append(base[at])
            at += 1
        open_ = [x for x in open_ if x[1] > m.start()]
        for piece in _pieces(text, m.start(), m.end(), open_):
            if t := tests(text[piece[0]:piece[1]]):
                found.append(t)
                places.append(piece)
    taken = [i + f for f in range(0, len(found), FAMILY) for i in random_tokens(found[f:f + FAMILY], alpha, rate)]
    reach = 0
    for a, b in sorted((places[i] for i in taken), key=lambda x: (x[0], -x[1])):
        if b > reach:
            spans.append(("random", a, b))
            reach = b
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans_column(text: Column, alpha: float = 0.001, rate: float = 0.01) -> Column:
    """Spans of a text column: array of (kind, start, end)."""
    ship_package()

    @F.pandas_udf("array<string>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[f"{k}:{a}:{b}" for k, a, b in scan(x, alpha, rate)] for x in batch], dtype=object)
    return F.transform(spans(text), lambda s: F.struct(
        F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("start"),
        F.split_part(s, F.lit(":"), F.lit(3)).cast("long").alias("end")))


def scan_secrets(docs: DataFrame, text: str = "text", alpha: float = 0.001, rate: float = 0.01) -> DataFrame:
    """``docs`` with ``secret_spans``; one pass, no shuffle."""
    return docs.withColumn("secret_spans", spans_column(F.col(text), alpha, rate))
