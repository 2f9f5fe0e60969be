"""URL filter: rules first, then a logistic regression on hashed character n-grams.

A URL is cut into host and path by native expressions.  A rule names a host
and the beginning of a path; it fits that host and all its subdomains, and of
the fitting rules the longest decides.  The other URLs are judged by a
logistic regression on the n-grams (``GRAMS`` bytes) of the host and of the
path: each, with its field, is hashed to one of ``2^BITS`` weights; a field's
edges are marked, and a row's features are scaled to unit length by the square
root of its number of n-grams.

The model is fitted to a small labelled table of URLs, ``MOST_LABELLED`` rows
at most (beyond, those of least hash of the URL are taken): full-batch
gradient steps with a ridge penalty, no randomness, so a rerun gives the same
weights.  They (2^BITS doubles, half a megabyte) go out in the task's closure.

Judging is row-local: no row is exchanged and no host or source can be hot.

Defined cases.  Null, or no ``://``: host and path are empty, which no rule
with a host fits; the model judges the empty URL.  An empty path fits no rule
(a rule's path begins with ``/``).  Rules of one length that both fit: the one
with the longer host, then the first by code point.  A rule given twice counts
once; its first verdict holds.  Long URLs are hashed whole.  Repeated rows are
judged each; an empty table gives no rows.  Labelled rows with a null URL or
label are left out; with none left, or one class only, that class (else
``allow``) is the verdict.  Other columns are not read, or ride along under their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import textkernel as tk

ALLOW, BLOCK = "allow", "block"
BITS = 16
GRAMS = (2, 3, 4)
MOST_LABELLED = 16_384
#: Rules are one expression each; a larger set would need a join.
MOST_RULES = 1_000
STEPS, RATE, RIDGE = 1500, 4.0, 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """``block example.com/en/``: a verdict, a host, and from the first ``/`` a path."""
    verdict, _, place = line.strip().partition(" ")
    host, slash, path = place.strip().partition("/")
    if verdict not in (ALLOW, BLOCK) or not host or not slash:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    at_host = (host == F.lit(rule.host)) | host.endswith("." + rule.host)
    return at_host & path.startswith(rule.path)


def ruled(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, else null."""
    first: dict[str, Rule] = {}
    for r in rules:
        first.setdefault(r.text, r)
    if len(first) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    longest = sorted(first.values(), key=lambda r: (-len(r.text), -len(r.host), r.text))
    found = [F.when(fits(r, host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
             for r in longest]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


# ---- features ---------------------------------------------------------------

def grams(column: pa.Array, field: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every n-gram of a field; each text lies between two marks."""
    data, offsets = tk.utf8(column)
    n = len(offsets) - 1
    begin = offsets[:-1] + 2 * np.arange(n)      # of the opening marks
    marked = np.zeros(len(data) + 2 * n, dtype=np.uint8)          # byte 0 is in no URL; as a mark it may be
    body = np.ones(len(marked), dtype=bool)
    body[begin] = body[begin + np.diff(offsets) + 1] = False
    marked[body] = data
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)
    features, rows = [], []
    for size in GRAMS:
        at = np.flatnonzero(row[size - 1:] == row[:len(row) - size + 1]) if len(row) >= size else np.zeros(0, int)
        value = np.full(len(at), field * 16 + size, dtype=_U)
        with np.errstate(over="ignore"):
            for j in range(size):
                value = value * _U(257) + marked[at + j]
        features.append((tk.mix64(value) >> _U(64 - bits)).astype(np.int64))
        rows.append(row[at])
    return np.concatenate(features), np.concatenate(rows)


@dataclass
class Features:
    """Hashed n-grams of a batch of URLs: features, their rows, a scale a row."""

    feature: np.ndarray
    row: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, host: pa.Array, path: pa.Array, bits: int = BITS) -> Features:
        parts = [grams(c, k, bits) for k, c in enumerate((host, path))]
        row = np.concatenate([r for _, r in parts])
        n = np.bincount(row, minlength=len(host))
        return cls(np.concatenate([f for f, _ in parts]), row, 1 / np.sqrt(np.maximum(n, 1)))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.feature], minlength=len(self.scale)) * self.scale

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, weights=(values * self.scale)[self.row], minlength=size)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def probability(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Of ``block``."""
        return 1 / (1 + np.exp(-(Features.of(host, path, self.bits).dot(self.weights) + self.bias)))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", bits: int = BITS) -> Model:
    """Model of ``url, label`` rows (``allow`` or ``block``)."""
    url = F.col(f"`{url_col}`")
    rows = (labelled.select(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"),
                            F.col(f"`{label_col}`").alias("label"))
            .where(F.col("url").isNotNull() & F.col("label").isin(ALLOW, BLOCK))
            .orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED).toArrow().combine_chunks())
    y = np.array([x == BLOCK for x in rows.column("label").to_pylist()], dtype=float)
    size = 1 << bits
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), 50.0 if len(y) and y[0] else -50.0, bits)
    x = Features.of(rows.column("host"), rows.column("path"), bits)
    # both classes weigh alike, however many rows they have
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    weights, bias = np.zeros(size), 0.0
    for _ in range(STEPS):
        off = share * (1 / (1 + np.exp(-(x.dot(weights) + bias))) - y)
        weights -= RATE * (x.back(off, size) + RIDGE * weights)
        bias -= RATE * off.sum()
    return Model(weights, float(bias), bits)


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = (), url_col: str = "url",
          keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, then ``host, path, rule, verdict, p_block`` of every row
    (``p_block``: the model's, null where a rule decides).  A kept column whose
    name clashes with a result column comes back inside ``row`` only: all kept
    columns are there too, as a struct."""
    ship_package(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("_"))
    parts = pages.select(row.alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("by", ruled(rules, F.col("host"), F.col("path")))
    parts = parts.select("row", "host", "path", "by.rule", "by.verdict")
    out = T.StructType([*parts.schema, T.StructField("p_block", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = np.array(batch.column("rule").is_valid().to_numpy(zero_copy_only=False))
            p = np.zeros(len(done))
            free = pa.array(np.flatnonzero(~done))
            if len(free):
                p[~done] = model.probability(batch.column("host").take(free), batch.column("path").take(free))
            said = batch.column("verdict").to_pylist()
            verdict = [v if v is not None else (BLOCK if x >= 0.5 else ALLOW) for v, x in zip(said, p.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "host", "path", "rule")), pa.array(verdict, pa.string()),
                 pa.array(p, mask=done)], ["row", "host", "path", "rule", "verdict", "p_block"])

    results = ["host", "path", "rule", "verdict", "p_block"]
    return parts.mapInArrow(run, out).select(
        "row", *[F.col(f"row.`{c}`").alias(c) for c in keep if c not in results and c != "row"], *results)
