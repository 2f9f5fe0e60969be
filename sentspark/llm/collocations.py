"""Phrase collocation mining by Rabin-Karp fingerprints.

A phrase is a run of words inside a piece of text.  Word hashes come from the
prefix polynomial of the bytes, phrase fingerprints from the prefix polynomial
of the word hashes, seeded by the language: every n-gram of a chunk in one
numpy expression, at a cost that does not depend on its length.

1. **Fingerprints.**  A task counts the words and pairs of up to
   ``FLUSH_TOKENS`` words and sends sorted distinct fingerprints with counts,
   packed per shard.  A shard is a range of fingerprints, so it is even
   whatever the texts hold; shards follow the bytes of the table
   (``SHARD_BYTES``).  A shard adds its runs up and marks the fingerprints of
   ``least`` and more occurrences in its range of a bit table.
2. **Occurrence pointers.**  A second pass keeps the n-grams whose words and
   pairs are all marked (no other can reach ``least``), and groups them by
   fingerprint, each group with a pointer to one occurrence.  Every other
   occurrence of a group is verified against the text there; a group of
   several texts (a collision) is split.  Pointers stay in the task that made
   them: the phrase is read from the text they point to, once a group.
3. **Phrases.**  Only these frequent phrases are materialised and shuffled, as
   compressed blocks by ranges of fingerprints; a range's counts are summed by
   text, so a collision across tasks parts here.  What remains is joins and
   windows of phrases.

The bit table (``TABLE_BITS``, 16 MB) is the only broadcast; it does not grow.
In a corpus with more frequent pairs than it can part, more phrases pass to
step 3, which counts exactly all the same.

Memory of a task: about 100 bytes a word of ``FLUSH_TOKENS`` words and one
text; a shard, about 30 bytes a word of ``SHARD_BYTES`` of text.

Defined cases.  Null text is empty and has no word; a language without words
has no rows.  Null language is ``und``, together with such as are called that.  Words are
runs of bytes other than space and tab inside a piece; A-Z are lower-cased.
Repeated rows count each.  Texts are read whole, of any length.  Ties go by
``a``, then by the phrase's bytes.  An empty table gives no rows.  Other
columns are not read, so none can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, ship_package
from . import textkernel as tk
from .ngram_lm import deltas, merge, pack, undo, unpack
from .tables import land, landed

LEAST, TOP, MOST_WORDS, COVERED = 10, 2000, 3, 50
#: Words that a task holds at a time.
FLUSH_TOKENS = 600_000
#: Bytes of text whose fingerprints one shard merges.
SHARD_BYTES = 16 << 20
TABLE_BITS = 27
#: Parts into which joins on a phrase's parts cut their keys: a common word begins many phrases.
SALTS = 8
#: Parts of a language's candidates that are cut to the best first.
TOP_PARTS = 16
NO_LANGUAGE = "und"

_U = np.uint64
PIECE_ENDS = np.zeros(256, dtype=bool)
PIECE_ENDS[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
SEPARATORS = PIECE_ENDS.copy()
SEPARATORS[[0x20, 0x09]] = True


# ---- n-grams of a chunk -----------------------------------------------------

@dataclass
class Held:
    """Words of some texts: the bytes with one space after each word, where
    each word lies in them, hashes, piece numbers and languages."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    piece: np.ndarray
    lang: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, lang: np.ndarray, texts: bool) -> Held:
        """``texts``: also keep the words' bytes."""
        w = tk.words(batch.column("text"), SEPARATORS)
        row = np.repeat(np.arange(len(w.first) - 1, dtype=np.int32), np.diff(w.first))
        ends = np.concatenate([[0], np.cumsum(PIECE_ENDS[w.data], dtype=np.int32)])
        piece, size = (ends[w.start] + row).astype(np.int32), (w.end - w.start).astype(np.int32)
        if not texts:
            none = np.zeros(0, dtype=np.int32)
            return cls(none.astype(np.uint8), none, none, w.hash, piece, lang[row])
        # one space after every word: phrases are slices, whatever white space the text has
        keep = np.zeros(len(w.data) + 1, dtype=np.int8)
        keep[w.start] += 1
        keep[w.end] -= 1                         # a text may end where the next begins
        inside = np.cumsum(keep[:-1]).astype(bool)
        to = np.cumsum(size + 1, dtype=np.int32)
        start = to - size - 1
        data = np.full(int(to[-1]) if len(to) else 0, 0x20, dtype=np.uint8)
        word = np.ones(len(data), dtype=bool)
        word[to - 1] = False
        data[word] = w.data[inside]
        return cls(data, start, start + size, w.hash, piece, lang[row])


def together(parts: list[Held]) -> Held:
    """Several chunks as one; pieces stay apart."""
    bytes_before = np.cumsum([0, *(len(p.data) for p in parts[:-1])], dtype=np.int32)
    pieces_before = np.cumsum([0, *(int(p.piece[-1]) + 1 if len(p.piece) else 0 for p in parts[:-1])], dtype=np.int32)
    join = lambda xs: np.concatenate(list(xs))
    return Held(join(p.data for p in parts),
                join(p.start + b for p, b in zip(parts, bytes_before)),
                join(p.end + b for p, b in zip(parts, bytes_before)), join(p.hash for p in parts),
                join(p.piece + b for p, b in zip(parts, pieces_before)), join(p.lang for p in parts))


class Fingerprints:
    """Rabin-Karp fingerprints of the n-grams of ``held``, with its words' hashes as letters."""

    def __init__(self, held: Held, seeds: np.ndarray, bits: int = 64) -> None:
        n = len(held.hash)
        self.held, self.up, self.down = held, *tk._POWERS.get(n + 1)
        self.mask = _U((1 << bits) - 1) << _U(64 - bits)       # fewer bits: collisions, for tests
        self.seed = seeds[held.lang] if n else np.zeros(0, dtype=_U)
        self.prefix = np.zeros(n + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum(held.hash * self.up[:n], out=self.prefix[1:])

    def begins(self, n: int) -> np.ndarray:
        """First words of all n-grams inside pieces."""
        piece = self.held.piece
        return np.flatnonzero(piece[n - 1:] == piece[:len(piece) - n + 1]) if len(piece) >= n else np.zeros(0, int)

    def at(self, begin: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.prefix[begin + n] - self.prefix[begin]) * self.down[begin]
            return tk.mix64(value ^ (self.seed[begin] + _U(n))) & self.mask


def _languages(chunk: pa.RecordBatch, numbers: dict[str, int]) -> np.ndarray:
    """A language number a row; new languages join ``numbers``."""
    names = [x if x is not None else NO_LANGUAGE for x in chunk.column("lang").to_pylist()]
    return np.array([numbers.setdefault(x, len(numbers)) for x in names], dtype=np.int32)


def _seeds(names: dict[str, int]) -> np.ndarray:
    """64 bits of each language by number."""
    column = pa.array(list(names), pa.string())
    none = np.zeros(256, dtype=bool)
    out = np.zeros(len(names), dtype=_U)
    w = tk.words(column, none)                   # a name is one word, or none if empty
    out[np.flatnonzero(np.diff(w.first))] = w.hash
    return tk.mix64(out)


def _flushes(batches: Iterator[pa.RecordBatch], limit: int, texts: bool) -> Iterator[tuple[Held, dict[str, int]]]:
    held: list[Held] = []
    size, names = 0, {}
    for batch in batches:
        for chunk in tk.chunks(batch, "text"):
            held.append(Held.of(chunk, _languages(chunk, names), texts))
            size += len(held[-1].hash)
            if size >= limit:
                whole, held, size = together(held), [], 0
                yield whole, names
                names = {}
    if held:
        yield together(held), names


# ---- 1: fingerprints --------------------------------------------------------

def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of fingerprints, by their leading bits."""
    return ((key >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _count(shards: int, bits: int, flush_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, names in _flushes(batches, flush_tokens, False):
            f = Fingerprints(held, _seeds(names), bits)
            keys = np.concatenate([f.at(f.begins(n), n) for n in (1, 2)])
            del held, f
            keys, counts = np.unique(keys, return_counts=True)
            cut = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            for s in range(shards):
                own = slice(cut[s], cut[s + 1])
                if cut[s + 1] > cut[s]:
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([s], pa.int32()), "n": pa.array([cut[s + 1] - cut[s]], pa.int64()),
                        "a": pa.array([pack(deltas(keys[own]))], pa.binary()),
                        "b": pa.array([pack(counts[own].astype(_U))], pa.binary())})
    return run


def _mark(least: int, table_bits: int):
    """A shard's part of the bit table: the index of its first byte, and its bytes."""
    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for n, a, b in zip(*(table.column(c) for c in ("n", "a", "b"))):
            keys.append(undo(unpack(a.as_py(), n.as_py())))
            counts.append(unpack(b.as_py(), n.as_py()))
        key, count = merge(np.concatenate(keys), np.concatenate(counts))
        at = np.unique((key[count >= least] >> _U(64 - table_bits)).astype(np.int64))
        if not len(at):
            return pa.table({"first": pa.array([], pa.int64()), "bytes": pa.array([], pa.binary())})
        first = int(at[0]) >> 3
        flags = np.zeros(((int(at[-1]) >> 3) - first + 1) * 8, dtype=np.uint8)
        flags[at - first * 8] = 1
        return pa.table({"first": pa.array([first], pa.int64()),
                         "bytes": pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary())})
    return run


def frequent(rows: DataFrame, least: int, shards: int, bits: int, table_bits: int, flush_tokens: int) -> np.ndarray:
    """Bit table of the fingerprints of words and pairs with ``least`` occurrences or more."""
    marked = (rows.mapInArrow(_count(shards, bits, flush_tokens), "shard int, n long, a binary, b binary").groupBy("shard")
              .applyInArrow(_mark(least, table_bits), "first long, bytes binary"))
    out = np.zeros(1 << (table_bits - 3), dtype=np.uint8)
    for r in marked.collect():                   # all parts together are the table, whatever the corpus
        part = np.frombuffer(zlib.decompress(bytes(r["bytes"])), dtype=np.uint8)
        out[r["first"]:r["first"] + len(part)] |= part
    return out


# ---- 2: occurrences ---------------------------------------------------------

def _is_marked(table: np.ndarray, table_bits: int, key: np.ndarray) -> np.ndarray:
    at = key >> _U(64 - table_bits)
    return (table[(at >> _U(3)).astype(np.int64)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1 == 1


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of all slices, one after another."""
    ends = np.cumsum(size, dtype=np.int32)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at), dtype=np.int32)
    return data[at]


def same_text(held: Held, one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-grams that begin at ``one`` and ``other`` are the same bytes in the same language."""
    size = held.end[one + n - 1] - held.start[one]
    same = (size == held.end[other + n - 1] - held.start[other]) & (held.lang[one] == held.lang[other])
    open_ = np.flatnonzero(same)
    step = 100_000                               # n-grams compared at a time
    for a in range(0, len(open_), step):
        own = open_[a:a + step]
        k = size[own]
        differ = gather(held.data, held.start[one[own]], k) != gather(held.data, held.start[other[own]], k)
        bounds = np.cumsum(k) - k
        same[own] = ~np.logical_or.reduceat(differ, bounds) if len(differ) else True
    return same


def groups(held: Held, begin: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A pointer to one occurrence of every different n-gram, and its number of occurrences."""
    pointers, counts = [], []
    while len(begin):
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        same = same_text(held, begin, begin[first][which], n)
        pointers.append(begin[first])
        counts.append(np.bincount(which[same], minlength=len(first)))
        begin, key = begin[~same], key[~same]    # collisions: the others go another round
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(pointers), np.concatenate(counts)) if pointers else (none, none)


def _occurrences(held_table, most: int, bits: int, table_bits: int, shards: int, flush_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held_table.value
        for held, names in _flushes(batches, flush_tokens, True):
            seeds = _seeds(names)
            f = Fingerprints(held, seeds, bits)
            # the number of all words stands under the empty phrase
            found = [(tk.mix64(seeds) & f.mask, np.arange(len(names)), np.zeros(len(names), np.int64), 0,
                      np.bincount(held.lang, minlength=len(names)))]
            marked = np.zeros(len(held.hash) + 1, dtype=bool)        # of the pair (word) that begins there
            for n in range(1, most + 1):
                begin = f.begins(n)
                if n <= 2:
                    key = f.at(begin, n)
                    fit = _is_marked(table, table_bits, key)
                    begin, key = begin[fit], key[fit]
                    marked[:] = False
                    marked[begin] = True
                else:                            # all its pairs must be marked
                    for j in range(n - 1):
                        begin = begin[marked[begin + j]]
                    key = f.at(begin, n)
                at, counts = groups(held, begin, key, n)
                found.append((f.at(at, n), held.lang[at], at, n, counts))
            yield from _blocks(held, list(names), found, shards)
    return run


_PHRASE = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _blocks(held: Held, names: list[str], found: list[tuple], shards: int) -> Iterator[pa.RecordBatch]:
    """One compressed block of phrases a shard."""
    key, lang, at, counts = (np.concatenate([r[k] for r in found]) for k in (0, 1, 2, 4))
    n = np.concatenate([np.full(len(r[0]), r[3], dtype=np.int32) for r in found])
    shard = shard_of(key, shards)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    names = pa.array(names, pa.string())
    last = len(held.end) - 1
    for s in range(shards):
        own = order[cut[s]:cut[s + 1]]
        if not len(own):
            continue
        begin, k = at[own], n[own]
        size = np.where(k > 0, held.end[np.clip(begin + k - 1, 0, last)] - held.start[np.minimum(begin, last)], 0) \
            if last >= 0 else np.zeros(len(own), np.int64)
        start = held.start[np.minimum(begin, last)] if last >= 0 else begin
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        phrase = pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets.tobytes()),
                                             pa.py_buffer(gather(held.data, start, size).tobytes()))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _PHRASE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(pa.RecordBatch.from_arrays(
                [names.take(pa.array(lang[own])), pa.array(k), phrase, pa.array(counts[own].astype(np.int64))],
                schema=_PHRASE))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()),
                                          "block": pa.array([out.getvalue().to_pybytes()], pa.binary())})


def _sum_phrases(least: int):
    """Exact counts of a shard's phrases, by their text."""
    def run(table: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(b.as_py()).read_all() for b in table.column("block")]
        whole = pa.concat_tables(parts).group_by(["lang", "words", "phrase"]).aggregate([("f", "sum")])
        whole = whole.rename_columns({"f_sum": "f"}).select(_PHRASE.names)
        keep = pc.or_(pc.greater_equal(whole.column("f"), least), pc.equal(whole.column("words"), 0))
        return whole.filter(keep).cast(_PHRASE)
    return run


def counted(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, lang_col: str = "lang",
            text_col: str = "text", shards: int | None = None, bits: int = 64,
            table_bits: int = TABLE_BITS, flush_tokens: int = FLUSH_TOKENS) -> DataFrame:
    """``lang, words, phrase, f``: exact counts of all phrases of 1 to ``most``
    words with ``least`` occurrences or more; ``words`` 0 holds the number of
    all words of a language."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    table = spark.sparkContext.broadcast(frequent(rows, least, shards, bits, table_bits, flush_tokens))
    found = rows.mapInArrow(_occurrences(table, most, bits, table_bits, shards, flush_tokens),
                            "shard int, block binary")
    return found.groupBy("shard").applyInArrow(_sum_phrases(least), "lang string, words int, phrase string, f long")


# ---- 3: scores --------------------------------------------------------------

def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST_WORDS, covered: int = COVERED,
         **of_counting) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top``
    phrases of 2 to ``most`` words, after those are dropped that a longer one
    covers (in ``covered`` percent or more of their occurrences)."""
    return scored(land(counted(docs, least, most, **of_counting), "phrases"), top, most, covered)


def scored(counts: DataFrame, top: int = TOP, most: int = MOST_WORDS, covered: int = COVERED) -> DataFrame:
    """``mine`` from the table of ``counted``."""
    candidates = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"))
    # longer candidates cover their parts
    parts = []
    for n in range(3, most + 1):
        for size in range(2, n):
            for k in range(n - size + 1):
                rest = F.substring_index("phrase", " ", -(n - k))
                parts.append(candidates.where(F.col("words") == n).select(
                    "lang", F.substring_index(rest, " ", size).alias("phrase"), F.col("a").alias("longer")))
    if parts:
        longer = parts[0]
        for p in parts[1:]:
            longer = longer.unionByName(p)
        longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        candidates = candidates.join(longer, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a"))).drop("longer")
    # every cut, with the counts of both sides; a common word is a hot key, so keys are salted
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", salt.alias("salt"),
        F.expr("substring_index(phrase, ' ', k)").alias("_left"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("_right"))
    known = counts.where(F.col("words").between(1, most - 1)).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for side in ("l", "r"):
        name = {"l": "_left", "r": "_right"}[side]
        cuts = cuts.join(known.select("lang", "salt", F.col("phrase").alias(name), F.col("f").alias(side)),
                         ["lang", "salt", name])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = (cuts.withColumn("_over", (wide("a") * wide("a")).cast("decimal(38,0)"))
            .withColumn("_under", (wide("l") * wide("r")).cast("decimal(38,0)"))
            .withColumn("score", F.expr("bigint(cast(1000000 * cast(_over as decimal(31,0)) as decimal(38,0)) div _under)")))
    best = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    # two levels, so that one language's candidates don't meet in one task: the first leaves TOP_PARTS * top of them
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    some = parts.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(
        F.col("_nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= top)
    every = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                             "n", "score")
