"""Interpolated modified Kneser-Ney model of order 2 or 3 (``ORDER``).

This module holds words and pairs, ``trigrams`` the triples above them.

Counting runs in Spark.  Tasks reduce their words, then their word pairs, to
sorted distinct keys with counts before anything is shuffled, packed as a few
compressed rows per task and shard, so a frequent word or pair is one entry of
one row.  Each shard becomes files of sorted arrays in the shared folder that
``spark.checkpoint.dir`` names:

* words (by hash): counts, left-context counts, and (at order 2) what follows
  them: how many pairs they begin, by count 1, 2, 3 and more;
* pairs (by the hash of both words' places): counts; at order 3 the triples
  give them, and no pass counts pairs.

Scoring is one pass over the documents.  A task maps the files into memory
(pages are read as needed and never count as its own) and looks up its sorted
distinct keys, shard by shard; from a store that can't be mapped it reads one
shard at a time.  Nothing but file names, sizes and counts of counts, one row
per shard, reaches the driver.

A word's place is its shard's base plus its index there.  The pairs of one
first word lie in one shard, unless the word is so frequent that its pairs
would outgrow it; those of such words are spread over all shards.

Memory of a task: about 80 bytes per token of ``FLUSH_TOKENS`` tokens, or one
shard when shards are merged; shards follow the bytes of the texts
(``SHARD_BYTES``), so a shard does not grow with the corpus.

Defined cases: null text has the end token alone; words are runs of bytes
other than ASCII white space, with A-Z lower-cased; a table without training
rows makes a model that knows no token and gives each 1 / (V + 1) with V = 0;
repeated rows count and are scored each; words are told apart by 64-bit hashes.
Long texts are read whole (a task holds one text beyond its bound).  Scores
have no ties to break.  Only the id, the text and the columns of ``used`` are
read, so other columns and their names don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_scratch, scratch_path, ship_package
from . import textkernel as tk
from .warc import filesystem

_U = np.uint64
#: Words of the longest n-grams.
ORDER = 3
#: Words that a task counts, or scores, at a time.
FLUSH_TOKENS, SCORED_TOKENS = 4_500_000, 1_800_000
#: Bytes of text whose n-grams one shard merges (a shard of a task each, at least one a shuffle partition).
SHARD_BYTES = 32 << 20
#: A first word with more than this share of a shard's tokens is spread.
SPREAD = 0.25
#: So many most frequent words of each shard can be found to be such.
FREQUENT = 256
#: The end token's hash: no word's, but by a collision.
END = _U(0x9D39247E33776D41)
_CODEC = pa.Codec("zstd", compression_level=1)
_PART = "shard int, n long, a binary, b binary, c binary"


# ---- packed arrays ----------------------------------------------------------

def pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit values by byte planes, compressed."""
    planes = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    return _CODEC.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(data, n * 8, asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of sorted values (the first from 0)."""
    with np.errstate(over="ignore"):
        return np.diff(x, prepend=_U(0))


def undo(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(x, dtype=_U)


def merge(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with the sums of each value."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[new], *(np.add.reduceat(v[order], new) for v in values))


# ---- files ------------------------------------------------------------------

@dataclass(frozen=True)
class Shards:
    """Files of one array, one per shard (``None``: empty)."""

    paths: tuple[str | None, ...]

    def load(self, shard: int) -> np.ndarray:
        path = self.paths[shard]
        if path is None:
            return np.zeros(0, dtype="<u8")
        dtype = f"<{path.rpartition('.')[2]}"
        fs, inner = filesystem(path)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(inner, dtype=dtype, mode="r")
        with fs.open_input_stream(inner) as f:    # a store that can't be mapped: this shard alone
            return np.frombuffer(f.read(), dtype=dtype)


def _store(folder: str, kind: str, shard: int, x: np.ndarray) -> str | None:
    """Write an array in the least unsigned type that holds it (the name's
    ending says which), under a name of its own: a repeated task never meets
    the file of another attempt, and a name counts only if its row arrives."""
    if not len(x):
        return None
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    kept = np.min_scalar_type(int(x.max()))
    x = x.astype(kept.newbyteorder("<"))
    name = f"{kind}-{shard:05d}-{uuid.uuid4().hex[:8]}.u{kept.itemsize}"
    with fs.open_output_stream(f"{inner}/{name}", compression=None) as out:
        out.write(memoryview(np.ascontiguousarray(x)).cast("B"))
    return f"{folder}/{name}"


# ---- words ------------------------------------------------------------------

def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, each text ending in ``END``, and text bounds (n + 1)."""
    w = tk.words(batch.column("text"), tk.SPACES)
    n = np.diff(w.first) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.full(bounds[-1], END, dtype=_U)
    body = np.ones(len(out), dtype=bool)
    body[bounds[1:] - 1] = False
    out[body] = w.hash
    return out, bounds


def _training(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch.column("train")) if "train" in batch.schema.names else batch


def by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by shard, and where each shard begins in it (shards + 1)."""
    if shards < 1 << 16:
        shard = shard.astype(np.uint16)          # sorted by radix
    order = np.argsort(shard, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _shard_rows(shard: np.ndarray, shards: int, key: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows by shard; ``key`` is sorted."""
    order, cut = by_shard(shard, shards)         # keys stay sorted within a shard
    for s in range(shards):
        own = order[cut[s]:cut[s + 1]]
        if len(own):
            blobs = [pack(deltas(key[own])), *(pack(v[own]) for v in values), b"", b""][:3]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([s], pa.int32()), "n": pa.array([len(own)], pa.int64()),
                **{c: pa.array([x], pa.binary()) for c, x in zip("abc", blobs)}})


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for whole in batches:
            for batch in tk.chunks(_training(whole), "text"):
                held.append(_tokens(batch)[0])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield from _flush_words(held, shards)
                    held, size = [], 0
        if held:
            yield from _flush_words(held, shards)
    return run


def _flush_words(held: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    yield from _shard_rows((keys % _U(shards)).astype(np.int64), shards, keys, counts.astype(_U))


def _merge_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for r in table.to_pylist():
            keys.append(undo(unpack(r["a"], r["n"])))
            counts.append(unpack(r["b"], r["n"]))
        shard = table.column("shard")[0].as_py()
        key, count = merge(np.concatenate(keys), np.concatenate(counts))
        top = np.argsort(count, kind="stable")[-FREQUENT:]
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(key)], pa.int64()),
                         "at": pa.array([top], pa.list_(pa.int64())),
                         "often": pa.array([count[top].astype(np.int64)], pa.list_(pa.int64())),
                         "total": pa.array([int(count.sum())], pa.int64()),
                         "words": [_store(folder, "words", shard, key)],
                         "counts": [_store(folder, "counts", shard, count)]})
    return run


@dataclass
class Vocabulary:
    """Sorted word hashes with their counts, by shard (hash modulo shards)."""

    shards: int
    sizes: list[int]
    tokens: int
    words: Shards
    counts: Shards

    def __post_init__(self) -> None:
        self.base = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.size = int(self.base[-1])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each (sorted distinct) hash, -1 if unknown."""
        out = np.full(len(keys), -1, dtype=np.int64)
        shard = (keys % _U(self.shards)).astype(np.int64)
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            out[own] = find(self.words.load(s), keys[own], self.base[s])
        return out

    def gather(self, files: Shards, places: np.ndarray) -> np.ndarray:
        """Values at known places of an array that lies beside the words."""
        out = np.zeros(len(places), dtype=_U)
        shard = np.searchsorted(self.base, places, side="right") - 1
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            values = files.load(s)
            if len(values):
                out[own] = values[places[own] - self.base[s]]
        return out


def find(array: np.ndarray, keys: np.ndarray, base: int = 0) -> np.ndarray:
    """Index (plus ``base``) of each key in a sorted array, -1 if absent."""
    if not len(array):
        return np.full(len(keys), -1, dtype=np.int64)
    k = np.minimum(np.searchsorted(array, keys), len(array) - 1)
    return np.where(array[k] == keys, k + base, -1)


# ---- pairs ------------------------------------------------------------------

def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tk.mix64(tk.mix64(first.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + second.astype(_U))


def pair_shard(first: np.ndarray, key: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the first word; by the whole pair if the first word is hot."""
    by_first = (tk.mix64(first.astype(_U)) % _U(shards)).astype(np.int64)
    if not len(hot):
        return by_first
    return np.where(np.isin(first, hot), (key % _U(shards)).astype(np.int64), by_first)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of all tokens (sorted), which of them each token is, and where texts begin."""
    begins = np.concatenate([b[:-1] + k for (t, b), k in
                             zip(held, np.cumsum([0, *(len(t) for t, _ in held[:-1])]))]).astype(np.int64)
    tokens = np.concatenate([t for t, _ in held])
    held.clear()                                 # let go before sorting
    keys, which = np.unique(tokens, return_inverse=True)
    return keys, which, begins


def shifted(x: np.ndarray, begins: np.ndarray, start: int) -> np.ndarray:
    """The value before each token; ``start`` where a text begins."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[begins] = start
    return out


def _pairs(held: list[tuple[np.ndarray, np.ndarray]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and second words of all pairs (the start context is place V)."""
    keys, which, begins = _joined(held)
    places = vocabulary.places(keys)
    if vocabulary.size < 1 << 30:
        places = places.astype(np.int32)
    second = places[which]
    return shifted(second, begins, vocabulary.size), second


def _count_pairs(held_vocabulary, hot: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for whole in batches:
            for batch in tk.chunks(_training(whole), "text"):
                held.append(_tokens(batch))
                size += len(held[-1][0])
                if size >= FLUSH_TOKENS:
                    yield from _flush_pairs(held, held_vocabulary.value, hot, shards)
                    held, size = [], 0
        if held:
            yield from _flush_pairs(held, held_vocabulary.value, hot, shards)
    return run


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and their counts."""
    if int(first.max(initial=0)) < 1 << 31:
        key, n = np.unique((first.astype(_U) << _U(32)) | second.astype(_U), return_counts=True)
        return (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64), n.astype(_U)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    return first[new], second[new], np.diff(np.append(new, len(first))).astype(_U)


def indexed_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, and which of them each pair is."""
    if int(first.max(initial=0)) < 1 << 31:
        key = (first.astype(_U) << _U(32)) | second.astype(_U)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        index = np.empty(len(key), dtype=np.int64)
        index[order] = np.cumsum(new) - 1
        key = key[new]
        return (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64), index
    pairs, index = np.unique(np.stack([first, second], axis=1), axis=0, return_inverse=True)
    return pairs[:, 0], pairs[:, 1], index.reshape(-1)


def _flush_pairs(held, vocabulary: Vocabulary, hot: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    first, second = _pairs(held, vocabulary)
    first, second, n = distinct_pairs(first, second)
    shard = pair_shard(first, pair_key(first, second), hot, shards)
    yield from _shard_rows(shard, shards, first.astype(_U), second.astype(_U), n)


_PAIR_ROW = ("shard int, n long, keys string, counts string, n1 long, n2 long, n3 long, n4 long, kind int, "
             "a binary, b binary, c binary")


def _merge_pairs(folder: str, base: np.ndarray):
    """One row with the shard's files and counts of counts, and packed rows for
    the words' shards: of second words how many pairs end in them (kind 0), of
    first words how many they begin by count 1, 2, 3 and more (kinds 1 to 3)."""
    def run(table: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for r in table.to_pylist():
            n = r["n"]
            parts.append((undo(unpack(r["a"], n)), unpack(r["b"], n), unpack(r["c"], n)))
        shard = table.column("shard")[0].as_py()
        first, second, n = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(pair_key(first, second), kind="stable")
        first, second, n = first[order], second[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        n = np.add.reduceat(n, new)
        first, second = first[new], second[new]
        key = pair_key(first, second)
        rows = [{"shard": -1, "n": shard, "keys": _store(folder, "pairs", shard, key),
                 "counts": _store(folder, "pair-counts", shard, n),
                 **{f"n{k}": int((n == k).sum()) for k in (1, 2, 3, 4)}}]
        follows = [(0, second), (1, first[n == 1]), (2, first[n == 2]), (3, first[n >= 3])]
        for kind, words in follows:
            places, count = np.unique(words, return_counts=True)
            cut = np.searchsorted(places, np.append(base, np.iinfo(np.int64).max))
            for s in range(len(base)):      # the last stands for the start context
                own = slice(cut[s], cut[s + 1])
                if cut[s + 1] > cut[s]:
                    rows.append({"shard": s, "n": int(cut[s + 1] - cut[s]), "kind": kind,
                                 "a": pack(deltas(places[own].astype(_U))), "b": pack(count[own].astype(_U))})
        return pa.Table.from_pylist(rows, _PAIR_ARROW)
    return run


_PAIR_ARROW = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.string()), ("counts", pa.string()),
                         *((f"n{k}", pa.int64()) for k in (1, 2, 3, 4)), ("kind", pa.int32()),
                         ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_BESIDE = ("left", "one", "two", "more")


def _merge_beside(folder: str, base: np.ndarray):
    """Arrays beside a shard's words: pairs that end in a word, and those it begins."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        size = int(base[shard + 1] - base[shard]) if shard + 1 < len(base) else 1
        out = [np.zeros(size, dtype=_U) for _ in _BESIDE]
        for r in table.to_pylist():
            at = undo(unpack(r["a"], r["n"])).astype(np.int64) - int(base[shard])
            out[r["kind"]][at] += unpack(r["b"], r["n"])
        left = out[0]
        row = {"shard": shard, **{name: _store(folder, name, shard, x) for name, x in zip(_BESIDE, out)},
               "start": [int(x[0]) for x in out] if shard + 1 == len(base) else None,
               **{f"n{k}": int((left == k).sum()) for k in (1, 2, 3, 4)},
               "n3up": int((left >= 3).sum()), "pairs": int(left.sum())}
        return pa.Table.from_pylist([row], _BESIDE_ARROW)
    return run


_BESIDE_ROW = ("shard int, left string, one string, two string, more string, start array<long>, "
               "n1 long, n2 long, n3 long, n4 long, n3up long, pairs long")
_BESIDE_ARROW = pa.schema([("shard", pa.int32()), *((x, pa.string()) for x in _BESIDE),
                           ("start", pa.list_(pa.int64())),
                           *((x, pa.int64()) for x in ("n1", "n2", "n3", "n4", "n3up", "pairs"))])


# ---- model ------------------------------------------------------------------

def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more (Chen and
    Goodman); a count of counts of 0 makes them half a count."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.01), k) for k, x in enumerate(d, 1))])


@dataclass
class Model:
    vocabulary: Vocabulary
    hot: np.ndarray
    pairs: Shards
    pair_counts: Shards
    beside: dict[str, Shards]
    documents: int
    start: list[int]
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    distinct_pairs: int
    unseen_mass: float
    triples: object = None                       # ``trigrams.Triples`` at order 3

    def lower(self, places: np.ndarray) -> np.ndarray:
        """Continuation probability of words by place (-1: unknown)."""
        v = self.vocabulary
        known = np.flatnonzero(places >= 0)
        base = self.unseen_mass / (v.size + 1)
        out = np.full(len(places), base)
        if len(known):
            left = v.gather(self.beside["left"], places[known]).astype(np.int64)
            out[known] += (left - self.word_discounts[np.minimum(left, 3)]) / max(1, self.distinct_pairs)
        return out

    def context(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that follow a context, and the mass left for the lower order."""
        v = self.vocabulary
        total, mass = np.zeros(len(places)), np.ones(len(places))
        known = np.flatnonzero((places >= 0) & (places < v.size))
        one, two, more = (v.gather(self.beside[x], places[known]).astype(float) for x in _BESIDE[1:])
        total[known] = v.gather(v.counts, places[known])
        begin = np.flatnonzero(places == v.size)
        total[begin] = self.documents
        d = self.pair_discounts
        for own, held in ((known, (one, two, more)), (begin, self.start)):
            taken = d[1] * held[0] + d[2] * held[1] + d[3] * held[2]
            seen = (held[0] + held[1] + held[2]) * np.ones(len(own))
            mass[own] = np.where(seen > 0, taken / np.maximum(total[own], 1), 1.0)
        return total, mass

    def count(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Training counts of distinct pairs of known places."""
        key = pair_key(first, second)
        shard = pair_shard(first, key, self.hot, self.vocabulary.shards)
        order, cut = by_shard(shard, self.vocabulary.shards)
        out = np.zeros(len(first), dtype=np.int64)
        for s in range(self.vocabulary.shards):
            own = order[cut[s]:cut[s + 1]]
            if len(own):
                own = own[np.argsort(key[own])]
                k = find(self.pairs.load(s), key[own])
                hit = k >= 0
                out[own[hit]] = self.pair_counts.load(s)[k[hit]]
        return out

    def log10(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 p(second | first) by places (first: V is the start; -1 unknown)."""
        if not len(first):
            return np.zeros(0)
        words, which = np.unique(second, return_inverse=True)
        lower = self.lower(words)[which]
        contexts, which = np.unique(first, return_inverse=True)
        total, mass = (x[which] for x in self.context(contexts))
        n = np.zeros(len(first), dtype=np.int64)
        known = np.flatnonzero((first >= 0) & (second >= 0))
        n[known] = self.count(first[known], second[known])
        held = np.maximum(n - self.pair_discounts[np.minimum(n, 3)], 0)
        return np.log10(np.where(total > 0, held / np.maximum(total, 1), 0.0) + mass * lower)


def train(docs: DataFrame, used: Column | None = None, shards: int | None = None, text_col: str = "text",
          order: int = ORDER) -> Model:
    """Model of the rows of ``docs`` for which ``used`` (over its columns) holds."""
    from . import trigrams
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "ngrams")
    rows = (docs.where(used) if used is not None else docs).select(F.col(f"`{text_col}`").alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    words = (rows.mapInArrow(_count_words(shards), _PART).groupBy("shard")
             .applyInArrow(_merge_words(folder), "shard int, n long, at array<long>, often array<long>, total long, "
                                               "words string, counts string"))
    got = {r.shard: r for r in words.collect()}  # one row per shard
    at = lambda found, name: Shards(tuple(getattr(found[s], name) if s in found else None
                                          for s in range(shards)))
    vocabulary = Vocabulary(shards, [got[s].n if s in got else 0 for s in range(shards)],
                            sum(r.total for r in got.values()), at(got, "words"), at(got, "counts"))
    # words with a large share of a shard's tokens: fewer than shards / SPREAD of them
    least = max(1, int(SPREAD * vocabulary.tokens / shards))
    hot_places = np.array(sorted(int(vocabulary.base[s]) + k for s, r in got.items()
                                 for k, n in zip(r["at"], r.often) if n > least), dtype=np.int64)
    documents = 0
    end = vocabulary.places(np.array([END], dtype=_U))
    if end[0] >= 0:
        documents = int(vocabulary.gather(vocabulary.counts, end)[0])
    if documents > least:
        hot_places = np.append(hot_places, vocabulary.size)
    held = spark.sparkContext.broadcast(vocabulary)   # file names and sizes, one per shard
    none = Shards((None,) * shards)
    triples, found, start = None, {}, []
    if order == 3:
        triples, seconds, start, drop = trigrams.train(rows, vocabulary, hot_places, held)
    else:
        pairs = (rows.mapInArrow(_count_pairs(held, hot_places, shards), _PART).groupBy("shard")
                 .applyInArrow(_merge_pairs(folder, vocabulary.base), _PAIR_ROW))
        drop = [scratch_path(spark, "ngram-pairs")]
        pairs.write.parquet(drop[0])
        pairs = spark.read.parquet(drop[0])
        found = {r.n: r for r in pairs.where("shard = -1").select("n", "keys", "counts", "n1", "n2", "n3", "n4").collect()}
        seconds = pairs.where("shard >= 0").select("shard", "n", "kind", "a", "b")
    beside = {r.shard: r for r in seconds.groupBy("shard")
              .applyInArrow(_merge_beside(folder, vocabulary.base), _BESIDE_ROW).collect()}
    for path in drop:
        drop_scratch(path)
    if order == 2:
        start = list(beside[shards].start[1:]) if shards in beside else [0, 0, 0]
    own = [r for s, r in beside.items() if s < shards]
    word_n = [sum(getattr(r, f"n{k}") for r in own) for k in (1, 2, 3, 4)]
    d = discounts(*word_n)
    distinct = sum(r.pairs for r in own)
    taken = d[1] * word_n[0] + d[2] * word_n[1] + d[3] * sum(r.n3up for r in own)
    return Model(vocabulary, hot_places, at(found, "keys") if found else none, at(found, "counts") if found else none,
                 {x: at(beside, x) for x in _BESIDE}, documents, start,
                 discounts(*(sum(getattr(r, f"n{k}") for r in found.values()) for k in (1, 2, 3, 4))), d, distinct,
                 taken / distinct if distinct else 1.0, triples)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for batch in tk.chunks(whole, "text"):
                tokens = _tokens(batch)
                held.append((batch.column("doc_id"), tokens))
                size += len(tokens[0])
                if size >= SCORED_TOKENS:
                    yield _score_block(m, held)
                    held, size = [], 0
        if held:
            yield _score_block(m, held)
    return run


def _score_block(m: Model, held) -> pa.RecordBatch:
    v = m.vocabulary
    ids, bounds = pa.concat_arrays([d for d, _ in held]), [b for _, (_, b) in held]
    tokens = [t for _, t in held]
    held.clear()
    keys, which, begins = _joined(tokens)
    places = v.places(keys)
    known = np.flatnonzero(places >= 0)
    count = np.zeros(len(keys))
    count[known] = v.gather(v.counts, places[known])
    base = np.log10((count + 1) / (v.tokens + (v.size + 1)))[which]
    # distinct pairs only, as numbers of the block's distinct words (the start comes after them)
    first = shifted(which, begins, len(keys))
    f, s, index = indexed_pairs(first, which)
    words = np.append(places, v.size)
    sizes = np.concatenate([np.diff(b) for b in bounds])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = lambda x: np.add.reduceat(x, begin)  # noqa: E731  every text has its end token
    if m.triples is None:
        logs = m.log10(words[f], words[s])[index]
    else:
        lower = m.triples.middle(m, words, f, s)[index]
        logs = m.triples.log10(m, words[f], words[s], index, words[first], lower)
    return pa.RecordBatch.from_pydict({
        "doc_id": ids, "n_tokens": pa.array(sizes, pa.int64()),
        "n_known": pa.array(total((places >= 0)[which].astype(np.int64))),
        "train_tokens": pa.array(np.full(len(sizes), v.tokens)),
        "base_score": pa.array(total(base)), "score": pa.array(total(logs))})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every
    row, ``score`` of the model's order; perplexity is ``10 ^ (-score / n_tokens)``."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)   # file names, sizes and discounts
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kinds = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(),
             "base_score": T.DoubleType(), "score": T.DoubleType()}
    return rows.mapInArrow(_score(held), T.StructType(
        [rows.schema["doc_id"], *(T.StructField(k, t) for k, t in kinds.items())]))
