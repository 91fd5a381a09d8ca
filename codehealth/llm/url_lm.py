"""URL filter: ratio of two character language models, in DataFrame operations only.

Rules (host and path prefixes, longest wins) judge some urls for certain. From these,
two Markov models of variable order learn the characters of accepted and of rejected
urls. Every context that occurs is kept, so the model grows with the urls; the
distribution after a context is smoothed with that of the next shorter one, and so on
down to the alphabet. A url's score is the mean
log-likelihood difference per character. The threshold is calibrated on rule-judged
urls that were not learned from: the one with the best balanced accuracy.

Urls are read as an alphabet of ``SYMBOLS``. The model's tables are joined with the
distinct runs of characters, not with every place; what has ``broadcast_rows`` rows or
fewer when counted is broadcast, the rest is shuffled.

Defined cases: a null url, and one without ``://``, has an empty host and path; a url
without characters scores 0; without rule-judged urls of both kinds all scores and the
threshold are 0; a score at the threshold is accepted; urls of any length are read
whole; repeated rows have equal results; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = LOWER + "0123456789" + ".-_/~^"  # ~: any other character, ^: before the first
START = "^"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


RULES = (
    Rule("org", "", "allow"),
    Rule("example.org", "es/", "block"),
    Rule("example.org", "en/1", "block"),
    Rule("com", "fr/", "allow"),
    Rule("com", "de/", "block"),
)


@dataclass(frozen=True)
class Params:
    order: int = 4  # longest context
    broadcast_rows: int = 200_000
    smooth: float = 8.0
    held_out: int = 5  # one judged url in so many calibrates
    steps: int = 200  # thresholds a unit of score
    limit: float = 3.0  # scores beyond are taken as the limit in calibration


def with_parts(pages: DataFrame) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path`` (from the slash up to ``?``, ``#`` or the end)."""
    at = F.instr("url", "://")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    has = F.col("url").isNotNull() & (at > 0)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return (pages.withColumn("host", F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""))
            .withColumn("path", F.when(has, path).otherwise("")))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith("/" + rule.path)


def with_rule(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Add ``rule`` and ``judged``: name and verdict of the longest rule that fits, or null."""
    rule = judged = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        rule, judged = F.when(_fits(r), r.name).otherwise(rule), F.when(_fits(r), r.verdict).otherwise(judged)
    return rows.withColumn("rule", rule).withColumn("judged", judged)


def symbols(url: Column) -> Column:
    lowered = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(lowered, r"[^a-z0-9.\-_/]", "~")


def _places(rows: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character: ``run`` is it with the ``order`` symbols before it."""
    padded = F.concat(F.lit(START * order), F.col("symbols"))
    return (rows.where("symbols != ''").withColumn("__padded", padded)
            .select(*keep, "__padded", F.explode(F.sequence(F.lit(1), F.char_length("symbols"))).alias("at"))
            .select(*keep, F.substr("__padded", F.col("at"), F.lit(order + 1)).alias("run")))


def model(judged: DataFrame, p: Params) -> list[DataFrame]:
    """For each order a table ``gram`` (context and next symbol), ``yes`` and ``no``: its places in accepted and
    rejected urls. All that occur are kept.

    Rows of ``judged`` have ``symbols`` and ``accepted`` (1 or 0).
    """
    long = saved(_places(judged, p.order, "accepted").groupBy("run").agg(
        F.sum("accepted").alias("yes"), F.sum(1 - F.col("accepted")).alias("no")))
    return [saved(long.groupBy(F.expr(f"right(run, {order + 1})").alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
            for order in range(p.order)] + [long.withColumnRenamed("run", "gram")]


def _sized(table: DataFrame, p: Params) -> DataFrame:
    """``table``, of saved rows, to be broadcast if it is counted as small."""
    return F.broadcast(table) if table.count() <= p.broadcast_rows else table


def with_ratio(runs: DataFrame, tables: list[DataFrame], p: Params) -> DataFrame:
    """``run`` and ``ratio``, the log ratio of its last symbol's probabilities after the symbols before.

    The probability after a context is its counts smoothed by the one after the context without its
    first symbol; a context that never occurs leaves that as it is. ``runs`` are distinct, so at most as many of
    them as there are symbols meet one long gram or context, and tables of short ones are small.
    """
    order = len(tables) - 1
    q_yes = q_no = F.lit(1.0 / (len(SYMBOLS) - 1))
    for k, t in enumerate(tables):
        grams = t.select(F.col("gram").alias(f"gram{k}"), F.col("yes").alias(f"yes{k}"), F.col("no").alias(f"no{k}"))
        runs = runs.join(_sized(grams, p), F.expr(f"right(run, {k + 1})") == F.col(f"gram{k}"), "left")
        after = t.groupBy(F.expr(f"left(gram, {k})").alias(f"context{k}")).agg(F.sum("yes").alias(f"all_yes{k}"), F.sum("no").alias(f"all_no{k}"))
        runs = runs.join(_sized(saved(after), p), F.expr(f"substring(run, {order + 1 - k}, {k})") == F.col(f"context{k}"), "left")
        yes, no, all_yes, all_no = [F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for c in ("yes", "no", "all_yes", "all_no")]
        runs = runs.select("run", *[c for c in runs.columns if c in ("p_yes", "p_no")], yes.alias("y"), no.alias("n"), all_yes.alias("ay"), all_no.alias("an"))
        if k:
            q_yes, q_no = F.col("p_yes"), F.col("p_no")
        runs = runs.select("run", ((F.col("y") + p.smooth * q_yes) / (F.col("ay") + p.smooth)).alias("p_yes"),
                           ((F.col("n") + p.smooth * q_no) / (F.col("an") + p.smooth)).alias("p_no"))
    return runs.select("run", F.ln(F.col("p_yes") / F.col("p_no")).alias("ratio"))


def with_score(rows: DataFrame, tables: list[DataFrame], p: Params, *keep: str) -> DataFrame:
    """``keep`` and ``score`` of each row; ``keep`` begins with a key that is unique."""
    places = _places(rows, len(tables) - 1, keep[0])
    runs = saved(with_ratio(places.select("run").distinct(), tables, p))
    scores = places.join(_sized(runs, p), "run").groupBy(keep[0]).agg(F.avg("ratio").alias("score"))
    return rows.select(*keep).join(scores, keep[0], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def threshold(scored: DataFrame, p: Params) -> float:
    """The score from which on urls are accepted; rows have ``score`` and ``accepted``."""
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(p.limit)), F.lit(-p.limit)) * p.steps)
    rows = scored.groupBy(step.alias("step")).agg(F.sum("accepted").alias("yes"), F.sum(1 - F.col("accepted")).alias("no")).orderBy("step").collect()
    yes, no = sum(r["yes"] for r in rows), sum(r["no"] for r in rows)  # at most 2 * limit * steps + 1 rows
    if not yes or not no:
        return 0.0
    best, at, below_yes, below_no = -1.0, 0.0, 0, 0
    for r in rows:
        if (value := (yes - below_yes) / yes + below_no / no) > best:
            best, at = value, r["step"] / p.steps
        below_yes, below_no = below_yes + r["yes"], below_no + r["no"]
    return at


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, p: Params = Params()) -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` of every page."""
    rows = pages.select("page_id", "url")
    rows = with_rule(with_parts(rows), rules).withColumn("symbols", symbols(F.col("url")))
    # pages of one url are judged as one
    urls = saved(rows.groupBy("url").agg(*[F.first(c).alias(c) for c in ("host", "path", "rule", "judged", "symbols")])
                 .withColumn("key", F.monotonically_increasing_id()))
    accepted = (F.col("judged") == "allow").cast("int").alias("accepted")
    apart = F.pmod(F.xxhash64("url"), F.lit(p.held_out)) == 0
    known = urls.where("judged is not null").select("key", "symbols", accepted, apart.alias("apart"))
    kinds = known.where(~F.col("apart")).agg(F.min("accepted"), F.max("accepted")).first()
    if kinds[0] == 0 and kinds[1] == 1:
        tables = model(known.where(~F.col("apart")), p)
        scored = saved(with_score(urls, tables, p, "key", "url", "host", "path", "rule", "judged"))
        cut = threshold(scored.where(apart & F.col("judged").isNotNull()).select("score", accepted), p)
    else:
        scored, cut = urls.withColumn("score", F.lit(0.0)), 0.0
    verdict = F.coalesce("judged", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    scored = scored.select(F.col("url").alias("of"), "host", "path", "rule", "score", verdict.alias("verdict"))
    return pages.select("page_id", "url").join(scored, F.col("url").eqNullSafe(F.col("of")), "left").select("page_id", "host", "path", "rule", "score", "verdict")
