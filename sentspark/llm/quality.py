"""Quality classifier: a regularised quadratic discriminant.

A document is a vector of transformed statistics of its whole text.  Class
means and covariances come from sums over all labelled training rows, added up
by Spark; only those sums (a few hundred numbers) reach the driver.  Each
covariance is shrunk towards the pooled one and towards a multiple of the
identity.  The score is the posterior of class 1: the logistic of the
difference of two Gaussian log-densities, each a Mahalanobis distance solved
with a Cholesky factor that is computed once and sent along.

Defined cases: null text counts as empty and gets a score like any other;
labels other than 0 and 1, and labels of unknown documents, are not used; a
document labelled twice counts twice; if a class has no training row, every
score is the share of class 1 among the labels (0.5 without any).  Statistics
are of the whole text, however long; repeated rows score alike; scores have no
ties to break; an empty table gives no rows.  ``score`` reads the id and the
text alone, ``keep`` carries all columns in one struct, so no names clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import textkernel as tk
from .tables import land

_PLAIN = b".,;:'\"()-"
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in _PLAIN]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
HIGH = np.zeros(256, dtype=bool)
HIGH[128:] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True

NAMES = ("log_words", "log_word_bytes", "symbols", "upper", "digits", "repeats", "sameness", "symbol_words",
         "log_line_words", "high_bytes", "same_lines", "stops")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(upto[offsets]).astype(np.float64)


def _distinct(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return np.bincount(of[new], minlength=n).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; shares are square-rooted, sizes logged."""
    raw, offsets = tk.utf8(column)
    n = len(offsets) - 1
    w = tk.words(column, tk.SPACES)
    count = np.diff(w.first)
    of = np.repeat(np.arange(n), count)
    words = np.maximum(count, 1).astype(np.float64)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    letters = np.maximum(_per_text(LETTER[raw], offsets), 1)
    again = np.zeros(len(w.hash), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    lines = tk.words(column, _NEWLINE)
    line_count = np.diff(lines.first)
    line_of = np.repeat(np.arange(n), line_count)
    some_lines = np.maximum(line_count, 1)
    share = lambda x, of_all: np.sqrt(np.clip(x / of_all, 0, 1))
    inside = w.end - w.start
    last = SYMBOL[raw[w.end - 1]] if len(inside) else np.zeros(0, dtype=bool)
    return np.column_stack([
        np.log1p(count), np.log1p(_sum(inside, w.first) / words),
        share(_per_text(SYMBOL[raw], offsets), size), share(_per_text(UPPER[raw], offsets), letters),
        share(_per_text(DIGIT[raw], offsets), size), share(_sum(again, w.first), words),
        share(count - _distinct(of, w.hash, n), words), share(_sum(last, w.first), words),
        np.log1p(count / some_lines), share(_per_text(HIGH[raw], offsets), size),
        share(line_count - _distinct(line_of, lines.hash, n), some_lines),
        share(_per_text(raw == 46, offsets), words)])


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(upto[first]).astype(np.float64)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.chunks(whole, "text"):
            x = statistics(batch.column("text"))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                              "x": pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
    k = total.shape[1]
    yield pa.RecordBatch.from_pydict({"label": pa.array(np.repeat([0, 1], k)), "k": pa.array(np.tile(np.arange(k), 2)),
                                      "value": pa.array(total.reshape(-1))})


def shrink(s: np.ndarray, n: float) -> np.ndarray:
    """Towards the mean variance times the identity, by the oracle
    approximating weight (Chen et al. 2010), 0.001 at least."""
    d = len(s)
    mu = np.trace(s) / d
    square = float((s * s).sum()) / d / d
    top = square + mu * mu
    bottom = (n + 1.0) * (square - mu * mu / d)
    weight = min(1.0, top / bottom) if bottom > 0 else 1.0
    weight = max(weight, 1e-3)
    return (1 - weight) * s + weight * max(mu, 1e-6) * np.eye(d)


@dataclass
class Discriminant:
    """Means, Cholesky factors and log priors of both classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    priors: list[float]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(sums: dict[int, np.ndarray], pool: float = 0.1) -> Discriminant:
    """From (count, sums, products) per class; ``pool`` of each covariance is the pooled one."""
    d = len(NAMES)
    counts = [float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)]
    if min(counts) < 2:
        return Discriminant([], [], [], counts[1] / sum(counts) if sum(counts) else 0.5)
    means = [sums[c][1:1 + d] / counts[c] for c in (0, 1)]
    covs = [sums[c][1 + d:].reshape(d, d) / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (covs[0] * counts[0] + covs[1] * counts[1]) / sum(counts)
    factors = [np.linalg.cholesky(shrink((1 - pool) * covs[c] + pool * pooled, counts[c])) for c in (0, 1)]
    return Discriminant(means, factors, [float(np.log(n / sum(counts))) for n in counts])


def train(docs: DataFrame, labels: DataFrame, used: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> tuple[Discriminant, DataFrame]:
    """Model, and ``doc_id, x`` of every row.  ``used``: which ``doc_id`` may be learned from."""
    ship_package(docs.sparkSession)
    x = land(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
             .mapInArrow(_statistics_of, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                                                       T.StructField("x", T.ArrayType(T.DoubleType()))])), "statistics")
    y = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("long").alias("label")) \
              .where("label in (0, 1)")
    y = y.where(used) if used is not None else y
    rows = (x.join(y, "doc_id").select("label", "x").mapInArrow(_sums, "label long, k long, value double")
            .groupBy("label", "k").agg(F.sum("value").alias("value")).collect())
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r.label, np.zeros(1 + len(NAMES) * (len(NAMES) + 1)))[r.k] = r.value
    return fit(sums), x


def _score(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(x))})
    return run


def score(docs: DataFrame, labels: DataFrame, used: Column | None = None, **columns: str) -> DataFrame:
    """``doc_id, score`` for every row."""
    model, x = train(docs, labels, used, **columns)
    return x.mapInArrow(_score(model), T.StructType([x.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def _keep(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.chunks(whole, "_text"):
                kept = model.score(statistics(batch.column("_text"))) >= threshold
                yield batch.drop_columns(["_text"]).filter(pa.array(kept))
    return run


#: Labelled ids that ``keep`` sends to every task, at most.
SENT_IDS = 500_000


def keep(docs: DataFrame, labels: DataFrame, threshold: float, used: Column | None = None,
         id_col: str = "doc_id", text_col: str = "text", sent_ids: int = SENT_IDS, **columns: str) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold`` (no exchange of
    texts).  Learning needs the statistics of labelled rows alone: up to
    ``sent_ids`` of their ids are sent to the tasks; beyond, every row's are
    computed for it, with the same result."""
    ids = labels.select(F.col(f"`{id_col}`").alias("_labelled")).distinct()
    rows = docs
    if ids.limit(sent_ids + 1).count() <= sent_ids:
        rows = docs.join(F.broadcast(ids), docs[f"`{id_col}`"] == ids["_labelled"], "left_semi")
    model, _ = train(rows, labels, used, id_col=id_col, text_col=text_col, **columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("_text"))
    return carried.mapInArrow(_keep(model, threshold), T.StructType([carried.schema["row"]])).select("row.*")
