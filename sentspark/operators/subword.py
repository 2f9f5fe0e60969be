"""Subword vocabulary learned from the corpus (T4).

**Learning** (``learn_subwords``) is byte-pair merging over word counts: the
most frequent pair of neighbouring symbols becomes a symbol, again and again
(ties: the pair that is first by code point).  Merges depend on each other, so
a job per merge would be the plain way.  Here a round makes many, exactly:

* Pair counts of all words are summed in Spark, and the most frequent pairs
  come back (``ACTIVE`` of them): *active* are those above the count ``floor``
  at which that list ends.
* A merge never makes a pair more frequent than the pair whose boundaries it
  takes over.  So no merge of a count above the floor ever touches a boundary
  between symbols that are not active now: words fall apart there.
* The pieces, counted in Spark, are few and short: ``MOST_PIECES`` at most
  reach the driver (with more, fewer pairs are made active).  Merging them in
  memory, with pair counts kept up to date by each merge, gives the merges of
  the whole corpus down to the floor, in order.  They are then applied to all
  words where those lie, a batch of words at once (``merge_rows``).

**Encoding** is ``tokenizing.SubwordTokenizer``: the longest known piece from
the left, then the longest continuation (``##``), as a pretrained word-piece
tokenizer does, in a flat trie that workers map (``trie.FlatTrie``).
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path, ship_package
from .tokenizing import CONTINUES, N_SPECIAL, SubwordTokenizer, string_bytes

#: Pairs made active in a round, at most and in the first, and most pieces of words that the driver merges.
ACTIVE, FIRST_ACTIVE = 4096, 64
MOST_PIECES = 100_000

Pair = tuple[str, str]


# ---- learning ---------------------------------------------------------------

def joined(left: str, right: str) -> str:
    return left + right.removeprefix(CONTINUES)


def merge_pieces(pieces: Sequence[tuple[Sequence[str], int]], floor: int, vocabulary: dict[str, int], room: int,
                 most: int | None = None) -> list[Pair]:
    """Merges (at most ``most``) of ``pieces`` (symbols, count) of a count of at
    least ``floor``, until ``vocabulary`` (to which they are added) has ``room`` entries.
    A pair that comes up again is merged again, which adds no entry."""
    words = [list(s) for s, _ in pieces]
    weight = [n for _, n in pieces]
    counts: Counter[Pair] = Counter()
    where: dict[Pair, set[int]] = defaultdict(set)
    for i, s in enumerate(words):
        for p in zip(s, s[1:]):
            counts[p] += weight[i]
            where[p].add(i)
    heap = [(-n, p) for p, n in counts.items() if n >= floor]
    heapq.heapify(heap)
    out: list[Pair] = []
    while heap and len(vocabulary) < room and len(out) != most:
        n, pair = heapq.heappop(heap)
        if counts[pair] != -n:
            continue                             # an older count of this pair
        out.append(pair)
        vocabulary.setdefault(joined(*pair), -n)
        changed = set()
        for i in where.pop(pair):
            old = words[i]
            new = merge_symbols(old, pair)
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:]):
                counts[p] -= weight[i]
                changed.add(p)
            for p in zip(new, new[1:]):
                counts[p] += weight[i]
                where[p].add(i)
                changed.add(p)
            words[i] = new
        for p in changed:
            if counts[p] >= floor:
                heapq.heappush(heap, (-counts[p], p))
    return out


def merge_symbols(symbols: Sequence[str], pair: Pair) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(joined(*pair))
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


# Words in tasks are rows of symbol numbers (little-endian int32 in a binary
# column): a letter has its code point's number, doubled, plus one if it
# continues a word; longer symbols are numbered from ``LONGER`` as they come up.
LONGER = 1 << 22
#: Merges looked up at a time; pair and place must fit 63 bits.
MOST_MERGES = 1 << 16


class Symbols:
    """Numbers of symbols and back; equal strings have equal numbers, however they were joined."""

    def __init__(self) -> None:
        self.longer: dict[str, int] = {}

    def number(self, symbol: str) -> int:
        inner = symbol.startswith(CONTINUES) and len(symbol) == len(CONTINUES) + 1
        if inner or len(symbol) == 1:
            return 2 * ord(symbol[-1]) + inner
        return self.longer.setdefault(symbol, LONGER + len(self.longer))

    def names(self, numbers: np.ndarray) -> list[str]:
        longer = list(self.longer)
        return [longer[n - LONGER] if n >= LONGER else (CONTINUES if n & 1 else "") + chr(n >> 1) for n in numbers.tolist()]

    def pairs(self, pairs: Sequence[Pair]) -> np.ndarray:
        return np.array([(self.number(a) << 23) | self.number(b) for a, b in pairs], dtype=np.int64)


def _packed(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary value a row; rows may not pass 2 GB together."""
    offsets = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<i4"))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after another, and each row's count."""
    data, start, end = string_bytes(column)
    return (data[start[0]:end[-1]].view("<i4").astype(np.int64) if len(start) else np.zeros(0, np.int64)), (end - start) // 4


def _neighbours(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's pair with the next one (-1: the last of its row), and its row."""
    row = np.repeat(np.arange(len(size)), size)
    pair = np.full(len(ids), -1, dtype=np.int64)
    if len(ids) > 1:
        pair[:-1] = np.where(row[:-1] == row[1:], (ids[:-1] << 23) | ids[1:], -1)
    return pair, row


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = 2 * np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64) + 1
        ids[np.cumsum(size) - size] -= 1
        yield pa.RecordBatch.from_arrays([_packed(ids, size), batch.column(1)], ["symbols", "cnt"])


def _summed(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the exact sum of each one's weights."""
    own, which = np.unique(values, return_inverse=True)
    total = np.zeros(len(own), dtype=np.int64)
    np.add.at(total, which, weight)
    return own, total


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of symbols of each batch, before any merge."""
    for batch in batches:
        ids, size = _unpacked(batch.column(0))
        own, total = _summed(ids, np.repeat(batch.column(1).to_numpy(), size))
        yield pa.RecordBatch.from_arrays([pa.array(Symbols().names(own), pa.string()), pa.array(total)], ["token", "cnt"])


def _pairs(symbols: Symbols):
    """Counts of neighbouring symbols of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = _unpacked(batch.column(0))
            pair, row = _neighbours(ids, size)
            at = np.flatnonzero(pair >= 0)
            own, total = _summed(pair[at], batch.column(1).to_numpy()[row[at]])
            yield pa.RecordBatch.from_arrays([pa.array(symbols.names(own >> 23), pa.string()),
                                              pa.array(symbols.names(own & ((1 << 23) - 1)), pa.string()),
                                              pa.array(total)], ["a", "b", "cnt"])
    return run


def merge_rows(ids: np.ndarray, size: np.ndarray, pairs: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges (``pairs``, in order, each ``made`` into a symbol) applied to all
    rows together: a step makes the next merge of every row that has one, at
    all its places from the left.  A pair can come up again, later."""
    most = len(pairs) + 1
    known = np.sort(pairs * most + np.arange(len(pairs)))
    out, ended = np.zeros(0, np.int64), np.zeros(0, np.int64)
    size_out = size.copy()
    rows, done = np.arange(len(size)), np.zeros(len(size), np.int64)
    kept_ids, kept_rows = [out], [ended]
    while len(rows):
        pair, row = _neighbours(ids, size)
        asked = pair * most + done[row]
        spot = np.searchsorted(known, asked)
        found = known[np.minimum(spot, len(known) - 1)] if len(known) else np.full(len(asked), -1)
        rank = np.where((pair >= 0) & (spot < len(known)) & (found // most == pair), found % most, len(pairs))
        begin = np.cumsum(size) - size
        best = np.minimum.reduceat(rank, begin)
        open_ = best < len(pairs)
        stay = open_[row]
        kept_ids.append(ids[~stay])
        kept_rows.append(rows[row[~stay]])
        size_out[rows[~open_]] = size[~open_]
        hit = stay & (rank == best[row])
        # of places that overlap (a symbol with itself) every other one, from the left
        at = np.flatnonzero(hit)
        first = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
        nth = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        at = at[nth % 2 == 0]
        ids = ids.copy()
        ids[at] = made[rank[at]]
        stay[at + 1] = False
        ids, row = ids[stay], row[stay]
        size = np.bincount(row, minlength=len(rows))[open_]
        rows, done = rows[open_], best[open_] + 1
    ids, row = np.concatenate(kept_ids), np.concatenate(kept_rows)
    return ids[np.argsort(row, kind="stable")], size_out


def _applied(symbols: Symbols, merges: Sequence[Pair]):
    pairs, made = symbols.pairs(merges), np.array([symbols.number(joined(*p)) for p in merges], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = _unpacked(batch.column(0))
            for a in range(0, len(pairs), MOST_MERGES):
                ids, size = merge_rows(ids, size, pairs[a:a + MOST_MERGES], made[a:a + MOST_MERGES])
            yield pa.RecordBatch.from_arrays([_packed(ids, size), batch.column(1)], ["symbols", "cnt"])
    return run


def _pieces(symbols: Symbols, active: Sequence[Pair]):
    """Runs of symbols whose neighbours are all active pairs, counted per batch."""
    known = symbols.pairs(active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = _unpacked(batch.column(0))
            pair, row = _neighbours(ids, size)
            last = np.flatnonzero(~np.isin(pair, known))             # a run ends with its row, too
            runs = np.diff(last, prepend=-1)
            coded = _packed(ids, runs).filter(pa.array(runs > 1)).dictionary_encode()
            own, total = _summed(coded.indices.to_numpy(), batch.column(1).to_numpy()[row[last[runs > 1]]])
            numbers, each = _unpacked(coded.dictionary.take(pa.array(own)))
            names = symbols.names(numbers)
            end = np.cumsum(each)
            found = [" ".join(names[e - n:e]) for e, n in zip(end.tolist(), each.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(total)], ["piece", "cnt"])
    return run


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def learn_subwords(df: DataFrame, col: str = "sentence", vocab_size: int = 32000, min_count: int = 2,
                   active: int = ACTIVE, most_pieces: int = MOST_PIECES) -> DataFrame:
    """T4: ``(token, id, cnt)``: single characters by frequency, then merges in
    order, until ``vocab_size`` ids (``N_SPECIAL`` reserved ones included) are
    used or no pair is left that occurs ``min_count`` times.

    Words are space-separated; a character or piece inside a word has the mark
    ``##``.  ``cnt`` is the count of the character, or of the pair when it was
    merged.  No table of candidates meets in one task: words, pairs and pieces
    are aggregated in Spark; the driver holds at most ``active`` pairs,
    ``most_pieces`` pieces and the vocabulary.
    """
    spark = df.sparkSession
    room = vocab_size - N_SPECIAL
    if room <= 0:
        raise ValueError("vocab_size must exceed the number of reserved ids")
    if room > LONGER:
        raise ValueError(f"at most {LONGER} entries can be numbered")
    ship_package(spark)
    words = (df.select(F.explode(F.split(col, " ", -1)).alias("token")).where(F.col("token") != "")
               .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))
    state, path = _stored(words.mapInArrow(_lettered, "symbols binary, cnt long"), "subwords")
    letters = (state.mapInArrow(_letters, "token string, cnt long").groupBy("token").agg(F.sum("cnt").alias("cnt"))
                    .orderBy(F.desc("cnt"), "token").limit(room).collect())        # at most the vocabulary
    symbols = Symbols()
    vocabulary: dict[str, int] = {r.token: r.cnt for r in letters}
    take = min(active, FIRST_ACTIVE)             # pairs made active; more as far as their pieces are few enough
    while len(vocabulary) < room:
        pairs = (state.mapInArrow(_pairs(symbols), "a string, b string, cnt long")
                      .groupBy("a", "b").agg(F.sum("cnt").alias("cnt")))
        top = pairs.orderBy(F.desc("cnt"), "a", "b").limit(active + 1).collect()
        if not top or top[0].cnt < min_count:
            break
        pieces = None
        while pieces is None:
            floor = min_count if len(top) <= take else max(min_count, top[take].cnt + 1)
            chosen = [(r.a, r.b) for r in top[:take] if r.cnt >= floor]
            one = not chosen                     # more ties than pairs: only the first is sure
            if one:
                chosen, floor = [(top[0].a, top[0].b)], top[0].cnt
            counted = (state.mapInArrow(_pieces(symbols, chosen), "piece string, cnt long")
                            .groupBy("piece").agg(F.sum("cnt").alias("cnt")))
            got = counted.limit(most_pieces + 1).collect()
            if len(got) <= most_pieces or len(chosen) == 1:
                pieces = [(r.piece.split(" "), r.cnt) for r in got]
            else:
                take = max(1, take // 4)
        if len(pieces) <= most_pieces // 4:
            take = min(active, take * 4)
        merges = merge_pieces(pieces, floor, vocabulary, room, 1 if one else None)
        if len(vocabulary) < room:
            before = path
            state, path = _stored(state.mapInArrow(_applied(symbols, merges), "symbols binary, cnt long"), "subwords")
            drop_scratch(before)
    drop_scratch(path)
    rows = [(t, N_SPECIAL + k, n) for k, (t, n) in enumerate(vocabulary.items())]
    return spark.createDataFrame(rows, "token string, id int, cnt long")


def subword_tokenizer(vocab: DataFrame) -> SubwordTokenizer:
    """A tokenizer of a ``(token, id)`` table for ``features.encode``; the table
    (a vocabulary) comes to the driver once and goes out as a mapped file."""
    table = vocab.select("token", F.col("id").cast("int").alias("id")).orderBy("id").toArrow()
    made = SubwordTokenizer.of(table.column("token").to_pylist(), table.column("id").to_numpy())
    made.trie.send(vocab.sparkSession)
    return made
