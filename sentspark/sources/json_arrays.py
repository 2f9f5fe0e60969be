"""JSON-array files read by many tasks.

An array file has no record borders that a byte range could look for: a brace
may lie in a string or at any depth.  Two passes over the file's splits find
them (Spark's text source cuts the file at ``}``, so any store it reads works):

1. Each split is scanned for both states in which it may begin, outside or
   inside a string: how many unescaped quotes it has, by how much the depth
   of brackets changes, and how low it goes.  One row a split comes back, and
   a running sum gives the true state and depth at each split's beginning, and
   the split in which the record that is open there began.
2. With these, each split's records are cut out.  Records that cross a border
   come in pieces, which are grouped by where the record began: a group is one
   record.

A task holds one Arrow batch and one record at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

_CUT = "}"
_OPENS, _CLOSES = (ord("{"), ord("[")), (ord("}"), ord("]"))


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files, each up to (without) a ``}``, in order within a split."""
    return (spark.read.option("lineSep", _CUT).text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """A split's pieces, batch by batch, as one text."""
    for batch in batches:
        paths, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(2).cast(pa.binary()).to_pylist()
        begin = 0
        for i in range(1, len(paths) + 1):
            if i == len(paths) or (paths[i], starts[i]) != (paths[begin], starts[begin]):
                yield paths[begin], starts[begin], b"}".join(values[begin:i]) + b"}"
                begin = i


@dataclass
class Scan:
    """Where a text's quotes and brackets lie.  Text ends with a ``}``, so a
    backslash never reaches over its end."""

    at: np.ndarray       # brackets
    change: np.ndarray   # of the depth at each
    quoted: np.ndarray   # whether an odd number of quotes lies before each
    quotes: int

    @classmethod
    def of(cls, text: bytes) -> Scan:
        data = np.frombuffer(text, dtype=np.uint8)
        quote = np.flatnonzero(data == ord('"'))
        slash = np.flatnonzero(data == ord("\\"))
        if len(slash):
            first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)             # of each run of backslashes
            last = slash[np.append(first[1:], len(slash)) - 1]
            odd = np.diff(np.append(first, len(slash))) % 2 == 1
            quote = quote[~np.isin(quote, last[odd] + 1)]
        opens, closes = np.isin(data, _OPENS), np.isin(data, _CLOSES)
        at = np.flatnonzero(opens | closes)
        return cls(at, np.where(opens[at], 1, -1), np.searchsorted(quote, at) % 2 == 1, len(quote))

    def outside(self, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
        """Brackets that count if the text begins so, and their changes."""
        real = self.quoted == in_string
        return self.at[real], self.change[real]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list] = {}
    for path, start, text in _texts(batches):
        scan = Scan.of(text)
        # by state at the split's beginning: quotes so far, depth, lowest depth
        row = held.setdefault((path, start), [0, [0, 0], [0, 0]])
        for state in (0, 1):
            depth = row[1][state] + np.cumsum(scan.outside(bool((state + row[0]) % 2))[1])
            if len(depth):
                row[2][state] = min(row[2][state], int(depth.min()))
                row[1][state] = int(depth[-1])
        row[0] += scan.quotes
    if held:
        yield pa.RecordBatch.from_pydict({
            "path": [p for p, _ in held], "start": pa.array([s for _, s in held], pa.int64()),
            "quotes": pa.array([r[0] for r in held.values()], pa.int64()),
            "depth": pa.array([r[1] for r in held.values()], pa.list_(pa.int64())),
            "lowest": pa.array([r[2] for r in held.values()], pa.list_(pa.int64()))})


@dataclass(frozen=True)
class Begin:
    """What holds at a split's beginning."""

    in_string: bool
    depth: int
    opened: int          # start of the split in which the open record began, if depth > 1


def states(rows) -> dict[tuple[str, int], Begin]:
    """``(path, start, quotes, depth, lowest)`` rows -> what holds where each split begins."""
    out: dict[tuple[str, int], Begin] = {}
    path, now = None, Begin(False, 0, -1)
    for r in sorted(rows, key=lambda r: (r.path, r.start)):
        if r.path != path:
            path, now = r.path, Begin(False, 0, -1)
        out[r.path, r.start] = now
        state = int(now.in_string)
        stays = now.depth > 1 and now.depth + r.lowest[state] > 1      # the open record does not end here
        now = Begin(bool((state + r.quotes) % 2), now.depth + r.depth[state], now.opened if stays else r.start)
    return out


def _records(begin):
    """Whole records (``opened`` null), and pieces of those that cross a border."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = begin.value
        key = None
        rows: list[tuple] = []
        for path, start, text in _texts(batches):
            if (path, start) != key:
                if key is not None and parts:
                    rows.append((key[0], opened, key[1], b"".join(parts)))
                key = (path, start)
                at = known[key]
                in_string, depth, opened = at.in_string, at.depth, at.opened
                parts: list[bytes] = []
                head = depth > 1                 # the record open at the beginning is not all here
            scan = Scan.of(text)
            place, change = scan.outside(in_string)
            after = depth + np.cumsum(change)
            starts = place[(after == 2) & (change == 1)]
            ends = place[(after == 1) & (change == -1)] + 1
            if depth > 1:                        # a record goes on
                parts.append(text[:ends[0] if len(ends) else len(text)])
                if len(ends):
                    rows.append((path, opened if head else None, start, b"".join(parts)))
                    parts, head, ends = [], False, ends[1:]
            rows += [(path, None, start, text[a:b]) for a, b in zip(starts, ends)]
            if len(starts) > len(ends):
                parts, opened = [text[starts[-1]:]], start
            in_string = bool((int(in_string) + scan.quotes) % 2)
            depth = int(after[-1]) if len(after) else depth
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if key is not None and parts:
            rows.append((key[0], opened, key[1], b"".join(parts)))
        if rows:
            yield _batch(rows)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, opened, start, text = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(path, pa.string()), pa.array(opened, pa.int64()), pa.array(start, pa.int64()),
         pa.array(text, pa.binary())], ["path", "opened", "start", "text"])


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of each element (an object or array) of the arrays at ``path``."""
    ship_package(spark)
    pieces = _splits(spark, path)
    found = pieces.mapInArrow(_summaries, "path string, start long, quotes long, depth array<long>, lowest array<long>")
    begin = spark.sparkContext.broadcast(states(found.collect()))      # one row a split
    rows = pieces.mapInArrow(_records(begin), "path string, opened long, start long, text binary")
    # ``opened`` and ``start`` name a record that crosses borders; the split where it began is its first piece
    crossing = rows.where("opened IS NOT NULL").groupBy("path", "opened").agg(
        F.array_sort(F.collect_list(F.struct("start", "text"))).alias("_p"))
    whole = F.aggregate("_p", F.lit(b""), lambda acc, x: F.concat(acc, x["text"]))
    return rows.where("opened IS NULL").select(F.col("text").cast("string").alias("record")).unionByName(
        crossing.select(whole.cast("string").alias("record")))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON-array files, a task for each of their splits
    (``spark.sql.files.maxPartitionBytes``).  Elements that are no objects have no row."""
    rows = array_records(spark, path).where(F.ltrim("record").startswith("{"))
    return rows.select(F.from_json("record", schema, {"mode": "PERMISSIVE"}).alias("_r")).select("_r.*")
