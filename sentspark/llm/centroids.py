"""Centroid clustering of integer vectors (k-means), pruned by Ptolemaic pivots.

Ptolemy's inequality holds in Euclidean space: for pivots p, q, a vector x and
a centroid c, ``d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|``.  Each
vector's squared distances to ``PIVOTS`` fixed pivots (chosen far apart among
the first centroids) are computed once and stored beside it; each round the
few centroid-pivot distances are new, and every pair of pivots bounds every
vector-centroid distance from below.  Bounds are rounded towards 0 by more
than floating point can err, so a centroid is skipped only if it is farther
than one already checked; all others are checked exactly in 64-bit integers.

A round is one scan of the stored vectors.  A task returns at most one row of
exact sums per cluster, so what is shuffled and collected is bounded by
clusters and tasks, not by vectors, and no cluster can be hot.  The centroids
(clusters x dimensions integers) go out in the task's closure.

Defined cases.  Vectors with another number of components, or with a null,
NaN or infinite one, are left out.  A component's integer is held within
+-2^26, so that distances fit in 64 bits; within that, sums are exact up to
2^37 vectors.  A sum of distances that does not fit in a long is null.  Equal distances go to
the smaller number.  Repeated ids are rows of their own; as first centroids
they follow each other by their components.  A null id hashes as an empty one.  Fewer vectors than
clusters: each is a centroid.  An empty table gives no rows.  Other columns
are not read, so none can clash; vectors have no text, and their length is fixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, ship_package
from .tables import land, landed

CLUSTERS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Pivots, and so ``PIVOTS * (PIVOTS - 1) / 2`` pairs that give bounds.
PIVOTS = 6
#: Bound of a component's integer.
MOST = 1 << 26
#: Relative slack of a bound; double arithmetic errs by less than 2^-49 here.
SLACK = 2.0 ** -44


def usable(vector: Column, dims: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (F.size(vector) == dims) & ~bad


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``floor(SCALE * x)``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.clip(np.floor(x * SCALE), -MOST, MOST).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one vector."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different rows, each the farthest from those before it."""
    if not len(x):
        return x
    chosen = [0]
    least = squared(x, x[0])
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(x, x[chosen[-1]]))
    return x[chosen]


@dataclass
class Search:
    """Nearest of ``centroids``, with the pivots' help."""

    centroids: np.ndarray
    pivots: np.ndarray

    def __post_init__(self) -> None:
        self.to_pivot = np.sqrt(np.stack([squared(self.centroids, p) for p in self.pivots], axis=1).astype(float))
        between = np.sqrt(np.stack([squared(self.pivots, p) for p in self.pivots], axis=1).astype(float))
        self.pairs = [(p, q, between[p, q]) for p in range(len(between)) for q in range(p)]

    def bounds(self, to_pivot: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, by vector and centroid."""
        low = np.zeros((len(to_pivot), len(self.centroids)))
        for p, q, apart in self.pairs:
            one = to_pivot[:, p, None] * self.to_pivot[None, :, q]
            two = to_pivot[:, q, None] * self.to_pivot[None, :, p]
            np.maximum(low, (np.abs(one - two) - SLACK * (one + two)) / apart, out=low)
        return low * low * (1 - SLACK)

    def nearest(self, x: np.ndarray, pivot2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid, and how many were checked."""
        low = self.bounds(np.sqrt(pivot2.astype(float)))
        guess = low.argmin(axis=1)
        label, checked = guess.copy(), np.ones(len(x), dtype=np.int32)
        d = x - self.centroids[guess]
        best = np.einsum("ij,ij->i", d, d)
        for k, c in enumerate(self.centroids):
            open_ = np.flatnonzero((low[:, k] <= best) & (guess != k))
            checked[open_] += 1
            d = squared(x[open_], c)
            nearer = (d < best[open_]) | ((d == best[open_]) & (k < label[open_]))
            best[open_[nearer]] = d[nearer]
            label[open_[nearer]] = k
        return label, best, checked


def _prepare(pivots: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column("x"), dims)
            far = np.stack([squared(x, p) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _lists(x, pa.int32()), _lists(far, pa.int64())], ["vec_id", "x", "pivot2"])
    return run


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(x.reshape(-1), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _searched(search: Search, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        x = _matrix(batch.column("x"), search.centroids.shape[1])
        yield batch, x, *search.nearest(x, _matrix(batch.column("pivot2"), len(search.pivots)))


def _sums(search: Search):
    """Per task one row a cluster: its number of vectors and the sums of their components."""
    k, dims = search.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, x, label, _, _ in _searched(search, batches):
            n += np.bincount(label, minlength=k)
            order = np.argsort(label, kind="stable")
            own, first = np.unique(label[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]),
                                          _lists(sums[some], pa.int64())], ["cluster", "n", "sums"])
    return run


def _assign(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, label, best, checked in _searched(search, batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(label, pa.int32()), pa.array(best, pa.int64()), pa.array(checked)],
                ["vec_id", "cluster", "distance", "checked"])
    return run


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Exact floors of the means; an empty cluster's centroid stays."""
    dims = centroids.shape[1]
    out = centroids.copy()
    per = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("sums")[j]) for j in range(dims)]).alias("sums"))
    for r in per.collect():                      # one row a cluster
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2:", dims: int = DIMS,
            pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, checked, cluster_inertia, inertia, centroid_sha256`` of every
    usable vector; ``checked`` is how many centroids were compared exactly.  The id column keeps its type."""
    spark = vectors.sparkSession
    ship_package(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("x")).where(
        usable(F.col("x"), dims))
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(order, "x").limit(clusters).select("x").toArrow()       # ``clusters`` rows
    centroids = integers(first.column("x").combine_chunks(), dims)
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in _RESULT.items()])
    far = far_apart(centroids, pivots)
    kept, path = landed(rows.mapInArrow(_prepare(far, dims), f"vec_id {id_type}, x array<int>, pivot2 array<long>"),
                        "vectors")
    for _ in range(rounds):
        centroids = moved(centroids, kept.mapInArrow(_sums(Search(centroids, far)),
                                                     "cluster int, n long, sums array<long>"))
    found = land(kept.mapInArrow(_assign(Search(centroids, far)),
                                 f"vec_id {id_type}, cluster int, distance long, checked int"), "clusters")
    drop_scratch(path)
    totals = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}    # one row a cluster
    inertia = sum(totals.values())
    fits = lambda v: v if v < 1 << 63 else None
    about = spark.createDataFrame(
        [(k, fits(v), fits(inertia), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest())
         for k, v in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", *_RESULT)


_RESULT = {"cluster": "int", "distance": "long", "checked": "int", "cluster_inertia": "long", "inertia": "long",
           "centroid_sha256": "string"}
