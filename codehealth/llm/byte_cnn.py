"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over fixed-length windows, each
filter keeps its maximum, and a softmax layer names the language. The network is
trained in numpy on windows of a bounded sample of labelled texts
(``Training.docs_per_language`` and ``Training.docs``) and then applied to all windows
of every whole text in batches; a text's probabilities are the mean of its windows',
weighted by their bytes.

For use, a filter is turned into tables: what each byte, or pair of bytes, adds to the
filter at each place.

Defined cases: a null text and a text without a letter are ``und`` with score 0; so is
every text if there is nothing to learn from; texts of any length are covered by
windows from end to end; ties go to the first language by name; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codehealth.llm.common import ship_package

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SALTS = 32  # parts in which the documents of a language are ranked


@dataclass(frozen=True)
class Training:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 8
    docs_per_language: int = 400  # bound of the labelled sample
    docs: int = 4000
    pieces: int = 4  # windows drawn from a sampled text
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    languages: list[str]
    window: int
    embed: np.ndarray  # 256 x embedding
    kernels: list[np.ndarray]  # for each width: width x embedding x filters
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width: tables for pairs of bytes, then for a last single byte."""
        tables = []
        for kernel in self.kernels:
            single = [(self.embed @ k).astype(np.float32) for k in kernel]
            parts = [(a[:, None, :] + b[None, :, :]).reshape(65536, -1) for a, b in zip(single[::2], single[1::2])]
            tables.append(parts + single[len(parts) * 2:])
        return tables


def _windows(data: bytes, window: int) -> np.ndarray:
    """The bytes as rows of ``window``, the last one padded with zeros."""
    rows = -(-len(data) // window)
    out = np.zeros(rows * window, dtype=np.uint8)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(rows, window)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], p: Training) -> Network | None:
    """Fit by Adam on cross-entropy; the maximum sends each gradient to one place of a window only."""
    languages = sorted(set(labels))
    if not languages:
        return None
    x, y = [], []
    for text, label in zip(texts, labels, strict=True):
        if data := text.encode():
            x.append(_windows(data[:p.window], p.window))
            y.append(languages.index(label))
    rng = np.random.default_rng(p.seed)
    k = len(p.widths)
    values = [rng.normal(0, 0.3, (256, p.embedding)), *[rng.normal(0, 0.3, (w, p.embedding, p.filters)) for w in p.widths],
              np.zeros(k * p.filters), rng.normal(0, 0.1, (k * p.filters, len(languages))), np.zeros(len(languages))]
    values[0][0] = 0  # the padding byte
    if x:
        x, y = np.concatenate(x), np.array(y)
        moments, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(p.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), p.batch):
                step += 1
                grads = _gradients(values, x[order[at:at + p.batch]], y[order[at:at + p.batch]], p)
                for v, g, m, s in zip(values, grads, moments, squares, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= p.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    embed, *kernels, bias, out, out_bias = values
    return Network(languages, p.window, embed, kernels, bias, out, out_bias)


def _gradients(values: list[np.ndarray], x: np.ndarray, y: np.ndarray, p: Training) -> list[np.ndarray]:
    embed, *kernels, bias, out, out_bias = values
    rows, filters = np.arange(len(x))[:, None], np.arange(p.filters)
    places, peaks = [], []
    for w, kernel in zip(p.widths, kernels, strict=True):
        span = p.window - w + 1
        act = sum((embed @ kernel[j])[x[:, j:j + span]] for j in range(w))
        places.append(act.argmax(axis=1))
        peaks.append(act[rows, places[-1], filters])
    pre = np.concatenate(peaks, axis=1) + bias
    hidden = np.maximum(pre, 0)
    error = _softmax(hidden @ out + out_bias)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    back = (error @ out.T) * (pre > 0)
    g_embed, g_kernels = np.zeros_like(embed), []
    for i, (w, kernel) in enumerate(zip(p.widths, kernels, strict=True)):
        part, g = back[:, i * p.filters:(i + 1) * p.filters], np.zeros_like(kernel)
        for j in range(w):
            table = np.zeros((256, p.filters))
            np.add.at(table, (x[rows, places[i] + j], filters), part)
            g_embed += table @ kernel[j].T
            g[j] = embed.T @ table
        g_kernels.append(g)
    g_embed[0] = 0
    return [g_embed, *g_kernels, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


class Predictor:
    """Applies a network to texts, ``rows`` windows at a time."""

    def __init__(self, net: Network, rows: int = 1024):
        self.net, self.rows, self.parts = net, rows, net.tables()

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        peaks = []
        for kernel, parts in zip(self.net.kernels, self.parts, strict=True):
            span, act, at = x.shape[1] - len(kernel) + 1, None, 0
            for part in parts:
                codes, at = (pairs[:, at:at + span], at + 2) if len(part) > 256 else (x[:, at:at + span], at + 1)
                add = part.take(codes, axis=0, mode="clip")
                act = add if act is None else np.add(act, add, out=act)
            peaks.append(act.max(axis=1))
        hidden = np.maximum(np.concatenate(peaks, axis=1) + self.net.bias, 0)
        return _softmax(hidden @ self.net.out + self.net.out_bias)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.net.languages)))
        sizes = np.zeros(len(texts))
        queue: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if queue:
                of = np.concatenate([np.full(len(w), i) for i, w, _ in queue])
                np.add.at(total, of, self.windows(np.concatenate([w for _, w, _ in queue])) * np.concatenate([n for *_, n in queue])[:, None])
                queue.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if not text or not LETTER.search(text):
                continue
            data = text.encode()
            x = _windows(data, self.net.window)
            n = np.full(len(x), self.net.window, dtype=float)
            n[-1] = len(data) - self.net.window * (len(x) - 1)
            sizes[i] = len(data)
            for at in range(0, len(x), self.rows):
                queue.append((i, x[at:at + self.rows], n[at:at + self.rows]))
                waiting += len(queue[-1][1])
                if waiting >= self.rows:
                    flush()
                    waiting = 0
        flush()
        for i in np.flatnonzero(sizes):
            p = total[i] / sizes[i]
            names[i], scores[i] = self.net.languages[int(p.argmax())], float(min(p.max(), 1.0))
        return names, scores


def predict_column(text: Column, net: Network | None) -> Column:
    """Struct of ``lang`` and ``score`` for a text column; the network is a few thousand numbers."""
    ship_package()

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(net) if net else None
        for batch in batches:
            texts = list(batch)
            lang, score = predictor.texts(texts) if predictor else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang": lang, "score": score})
    return predicted(text)


def held_out(doc_id: Column) -> Column:
    """One document in three is never learned from (null ids are)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, p: Training = Training()) -> Network | None:
    """Train on a sample of the labelled documents that aren't held out.

    The sample is the documents with the smallest hash of their id, so many per
    language; of each come a few pieces from all over its text.
    """
    order = F.xxhash64("doc_id")
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a language may hold a third of all rows: its ids are ranked in SALTS parts, then the best of these
    salt = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(SALTS)).alias("salt")
    rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(order, "doc_id"))
    best = known.select("doc_id", "lang", salt).withColumn("rank", rank).where(F.col("rank") <= p.docs_per_language).drop("rank", "salt")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    chosen = best.withColumn("rank", rank).where(F.col("rank") <= p.docs_per_language)
    chosen = chosen.orderBy("rank", order, "lang").limit(p.docs).select("doc_id").distinct()
    room = F.greatest(F.char_length("text") - p.window, F.lit(0)) + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(p.pieces)), lambda i: F.substr(
        F.col("text"), F.pmod(F.xxhash64(F.col("doc_id"), i), room).cast("int") + 1, F.lit(p.window)))
    rows = (known.join(F.broadcast(chosen), "doc_id")  # at most p.docs ids
            .select("doc_id", "lang", F.explode(F.array_distinct(pieces)).alias("piece"))
            .orderBy("doc_id", "lang", "piece").limit(2 * p.docs * p.pieces).collect())
    rows = [r for r in rows if LETTER.search(r["piece"])]
    return train([r["piece"] for r in rows], [r["lang"] for r in rows], p)


def identify(docs: DataFrame, net: Network | None, out: str = "lang_id") -> DataFrame:
    """``docs`` with a struct of ``lang`` and ``score``; one pass, no shuffle."""
    return docs.withColumn(out, predict_column(F.col("text"), net))
