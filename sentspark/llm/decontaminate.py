"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words (64-bit hashes of them).  Every window of benchmark
words is a pattern; patterns of one length share tables.  A block is up to
three words.  The shift table, addressed by a block's hash, tells how far the
end of a window must lie beyond the block, so a search skips positions at
which no window can end; at shift 0 the block's whole hash selects the bucket
of windows with that suffix, and their words are compared directly, bytes
included.  A chunk of documents is cut into lanes of a few hundred possible
end positions that all advance together, each by its own shift.

The benchmark is read in parts of bounded size (``PART_BYTES`` of text, tables
of at most ``SHIFT_BITS``), whose tables are files in the shared folder that
``spark.checkpoint.dir`` names.  There is one pass over the documents, however
large the benchmark: a task splits a buffer of ``BUFFER_BYTES`` of text into
words once and searches it part by part, with the tables of one part in memory
at a time.  Documents never leave their partitions and nothing is written between.

Defined cases: null texts have no words; an item without words is no pattern;
items with equal ids are one item; a null item id counts as an empty string;
repeated rows are searched each on its own; empty tables give no hits.  Texts
are searched whole, however long.  An item found in several places counts once;
items are listed in order.  The kept columns travel in one struct, so no names clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package
from . import textkernel as tk
from .warc import filesystem

WINDOW = 10
#: Bytes of benchmark text in one broadcast part.
PART_BYTES = 1 << 20
#: Most bits of a shift table's address (16 MB of bytes); a fuller table only skips less.
SHIFT_BITS = 24
#: Bytes of text that a task holds while it goes through several parts.
BUFFER_BYTES = 8 << 20
LANE = 256
PAIRS = 1 << 18
_U = np.uint64

OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                     T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])


def _block_hash(h: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each position of ``end``."""
    with np.errstate(over="ignore"):
        out = h[end - (size - 1)]
        for k in range(size - 2, -1, -1):
            out = out * _U(0x100000001B3) + h[end - k]
    return tk.mix64(out)


class _Length:
    """Tables of the windows of one length: ``at`` is where each begins among
    the benchmark's words, ``items`` which items hold it (CSR)."""

    def __init__(self, h: np.ndarray, at: np.ndarray, item: np.ndarray, length: int) -> None:
        self.length = length
        self.block = 3 if length >= 6 else min(2, length)
        whole = np.stack([h[at + k] for k in range(length)], axis=1)
        _, first, which = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        pairs = np.unique(np.stack([which, item], axis=1), axis=0)
        self.item = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        at = at[first]
        bits = max(10, min(SHIFT_BITS, int(np.ceil(np.log2(len(at) * length + 1))) + 3))
        self.mask = _U((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.min_scalar_type(-length))
        for q in range(self.block - 1, length):
            slot = (_block_hash(h, at + q, self.block) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slot, self.shift.dtype.type(length - 1 - q))
        suffix = _block_hash(h, at + length - 1, self.block)
        order = np.argsort(suffix, kind="stable")
        self.at, self.suffix = at[order], suffix[order]
        kept = np.diff(self.item_from)[order]
        start = self.item_from[:-1][order]
        self.item = self.item[_ranges(start, kept)]
        self.item_from = np.concatenate([[0], np.cumsum(kept)])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them), for every i."""
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(start - (np.cumsum(count) - count), count)


class Matcher:
    """All windows of one part of a benchmark."""

    def __init__(self, items: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        self.names = sorted(set(items))
        number = {name: k for k, name in enumerate(self.names)}
        w = tk.words(pa.array(texts, pa.string()), tk.NOT_ALNUM)
        self.hash = w.hash
        self.bytes = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
        found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for k, name in enumerate(items):
            a, b = int(w.first[k]), int(w.first[k + 1])
            if a == b:
                continue
            length = min(window, b - a)
            at, item = found.setdefault(length, ([], []))
            begins = np.arange(a, b - length + 1)
            at.append(begins)
            item.append(np.full(len(begins), number[name]))
        self.lengths = [_Length(self.hash, np.concatenate(at), np.concatenate(item), length)
                        for length, (at, item) in sorted(found.items())]

    def search(self, w: tk.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, _Length]]:
        """``(length, document, end position, window, tables)`` of occurrences."""
        docs = len(w.first) - 1
        for t in self.lengths:
            lo = w.first[:-1] + t.length - 1
            room = np.maximum(w.first[1:] - lo, 0)
            lanes = -(-room // LANE)
            doc = np.repeat(np.arange(docs), lanes)
            p = lo[doc] + LANE * _ranges(np.zeros(docs, dtype=np.int64), lanes)
            stop = np.minimum(p + LANE, w.first[1:][doc])
            while len(p):
                block = _block_hash(w.hash, p, t.block)
                step = t.shift[(block & t.mask).astype(np.int64)]
                hit = np.flatnonzero(step == 0)
                if len(hit):
                    a = np.searchsorted(t.suffix, block[hit], side="left")
                    n = np.searchsorted(t.suffix, block[hit], side="right") - a
                    yield from self._confirm(w, t, doc[hit], p[hit], a, n)
                p = p + np.maximum(step, 1).astype(np.int64)
                on = p < stop
                p, stop, doc = p[on], stop[on], doc[on]

    def _confirm(self, w, t, doc, p, a, n):
        upto = np.cumsum(n)
        at = 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            window = _ranges(a[at:to], n[at:to])
            end = np.repeat(p[at:to], n[at:to])
            of = np.repeat(doc[at:to], n[at:to])
            for k in range(t.length):
                same = self.hash[t.at[window] + k] == w.hash[end - t.length + 1 + k]
                window, end, of = window[same], end[same], of[same]
            if len(window):
                ok = np.fromiter((self._equal(w, t, x, e) for x, e in zip(window, end)), dtype=bool,
                                 count=len(window))
                yield t.length, of[ok], end[ok], window[ok], t
            at = to

    def _equal(self, w, t, window: int, end: int) -> bool:
        at, first = int(t.at[window]), int(end) - t.length + 1
        return all(self.bytes[at + k] == w.data[w.start[first + k]:w.end[first + k]].tobytes()
                   for k in range(t.length))


class Chunk:
    """A chunk of rows with the words of its texts and what was found in them."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.row = batch.column("row")
        self.words = tk.words(batch.column("text"), tk.NOT_ALNUM)
        self.edge = np.zeros(len(self.words.hash) + 1, dtype=np.int64)
        self.items: list[set[str]] = [set() for _ in range(batch.num_rows)]

    def search(self, matcher: Matcher) -> None:
        for length, doc, end, window, t in matcher.search(self.words):
            np.add.at(self.edge, end - length + 1, 1)
            np.add.at(self.edge, end + 1, -1)
            n = t.item_from[window + 1] - t.item_from[window]
            pairs = np.unique(np.stack([np.repeat(doc, n), t.item[_ranges(t.item_from[window], n)]], axis=1), axis=0)
            for k, item in pairs.tolist():
                self.items[k].add(matcher.names[item])

    def found(self) -> pa.RecordBatch:
        w = self.words
        hit = np.concatenate([[False], np.cumsum(self.edge[:-1]) > 0, [False]])
        # a span also ends where its text does
        inside = hit[1:-1]
        border = np.zeros(len(inside) + 1, dtype=bool)
        border[w.first] = True
        starts = np.flatnonzero(inside & (~hit[:-2] | border[:-1]))
        ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | border[1:])) + 1
        of = np.searchsorted(w.first, starts, side="right") - 1
        offsets = pa.array(np.searchsorted(starts, w.first).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(starts - w.first[of], pa.int64()),
                                            pa.array(ends - w.first[of], pa.int64())], ["start", "end"])
        return pa.RecordBatch.from_pydict({
            "row": self.row, "n_words": pa.array(np.diff(w.first), pa.int64()),
            "spans": pa.ListArray.from_arrays(offsets, spans),
            "items": pa.array([sorted(x) for x in self.items], pa.list_(pa.string()))})


@lru_cache(maxsize=1)
def _opened(path: str) -> Matcher:
    """The tables of one part; those of another are let go."""
    fs, inner = filesystem(path)
    with fs.open_input_stream(inner) as f:
        return pickle.loads(f.read())


def _stored(matcher: Matcher, folder: str, k: int) -> str:
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/part-{k:05d}", compression=None) as out:
        out.write(pickle.dumps(matcher, protocol=5))
    return f"{folder}/part-{k:05d}"


def _search(paths: Sequence[str], buffer_bytes: int):
    def flush(held: list[Chunk]) -> Iterator[pa.RecordBatch]:
        for path in paths:
            matcher = _opened(path)
            for chunk in held:
                chunk.search(matcher)
        for chunk in held:
            yield chunk.found()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Chunk] = []
        size = 0
        for whole in batches:
            for batch in tk.chunks(whole, "text"):
                held.append(Chunk(batch))
                size += len(held[-1].words.data)
                if len(paths) == 1 or size >= buffer_bytes:      # one part stays open anyway
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


def parts(benchmark: DataFrame, part_bytes: int = PART_BYTES, window: int = WINDOW, id_col: str = "item_id",
          text_col: str = "text") -> Iterator[Matcher]:
    """The benchmark's windows in parts of at most ``part_bytes`` of text (one
    item at least); only one part is held at a time."""
    items: list[str] = []
    texts: list[str | None] = []
    size, given = 0, False
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"),
                            F.col(f"`{text_col}`").alias("t"))
    for row in rows.toLocalIterator():
        n = len((row.t or "").encode())
        if items and size + n > part_bytes:
            yield Matcher(items, texts, window)
            items, texts, size, given = [], [], 0, True
        items.append(row.i)
        texts.append(row.t)
        size += n
    if items or not given:
        yield Matcher(items, texts, window)


def annotate(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] | None = None, window: int = WINDOW,
             part_bytes: int = PART_BYTES, text_col: str = "text", buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """``row, n_words, spans, items`` for every row: its columns ``keep`` (all
    by default) as a struct, the spans of hit words (counted from 0, end
    exclusive) and the sorted ids of found items."""
    spark = docs.sparkSession
    ship_package(spark)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
                     F.col(f"`{text_col}`").alias("text"))
    folder = scratch_path(spark, "benchmark-parts")
    paths = [_stored(m, folder, k) for k, m in enumerate(parts(benchmark, part_bytes, window))]   # one at a time
    return df.mapInArrow(_search(paths, buffer_bytes), T.StructType([df.schema["row"], *OUT]))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs (no exchange)."""
    return annotate(docs, benchmark, **options).where(F.size("spans") == 0).select("row.*")
