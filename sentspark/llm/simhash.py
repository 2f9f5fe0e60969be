"""SimHash near-duplicates by an anchor-point covering.

A fingerprint is the majority of the hash bits of a text's shingles.  Anchors
are the codewords of a covering code: the fingerprint's first 46 bits are two
blocks of the perfect binary Golay code of 23 bits, in which every word lies
within 3 bits of exactly one codeword; the other 18 bits are left free.  Each
fingerprint has a home, the pair of nearest codewords, and is copied to every
anchor within covering radius plus threshold (block by block: the bits beyond
radius 3, over both blocks, are at most the threshold).  If two fingerprints
differ in at most that many bits, each is copied to the other's home, so
comparing homes with copies per anchor finds every link.  About 61 rows of 24
bytes per different fingerprint are shuffled at threshold 2.

Equal fingerprints are one node with its least id before anything is copied.
An anchor gives a spanning forest of its links, never all pairs; components
come from the union of the forests.  A full anchor (more than ``DIRECT``
comparisons) is split once more, by pigeonhole: of ``max_bits + 1`` fields that
share the 64 bits, two linked fingerprints have one alike, so it compares
homes only with those alike in a field.  Its memory is 17 bytes a row and a
block of ``BLOCK`` comparisons.

Defined cases: null and wordless texts have fingerprint 0 and are linked like
any other; fewer words than a shingle make one shingle; repeated rows are
alike; a null id belongs to its component but never names it (a component of
null ids alone has a null name); an empty table gives an empty result.  All
shingles of a text count, however long it is; a bit set in exactly half of them
is 0.  Only the id and the text are read, and ``dedup`` carries all columns in
one struct, so no names clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import textkernel as tk
from .components import components
from .tables import land, pick, row_key

SHINGLE = 3
MAX_BITS = 2
SEED = 42

#: The Golay code's length, covering radius and generator
#: polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
N, RADIUS, GENERATOR = 23, 3, 0b110001110101
_U = np.uint64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8").lower().split()   # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    span = min(shingle, len(words))
    last = len(words) - span + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in
                          zip(starts[:last].tolist(), ends[span - 1:].tolist())), dtype=_U, count=last)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, last, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.chunks(whole, "text"):
                prints = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()),
                                     dtype=_U, count=batch.num_rows)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                                  "row_key": batch.column("row_key"),
                                                  "print": pa.array(prints.view(np.int64))})
    return run


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    rest = words.copy()
    for bit in range(N - 1, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - 11), 0)
    return rest


class Cosets:
    """For each syndrome, the error patterns of up to ``RADIUS + beyond`` bits
    by how many bits beyond the radius they have (CSR per excess)."""

    def __init__(self, beyond: int) -> None:
        by_excess: list[list[int]] = [[] for _ in range(beyond + 1)]
        for weight in range(RADIUS + beyond + 1):
            by_excess[max(0, weight - RADIUS)] += [sum(1 << k for k in c) for c in combinations(range(N), weight)]
        self.patterns, self.begin = [], []
        for patterns in by_excess:
            e = np.array(patterns, dtype=np.int64)
            s = _syndrome(e)
            order = np.argsort(s, kind="stable")
            self.patterns.append(e[order])
            self.begin.append(np.searchsorted(s[order], np.arange((1 << 11) + 1)))

    def codewords(self, words: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the word and codeword, for all codewords at that excess."""
        s = _syndrome(words)
        begin = self.begin[excess]
        n = begin[s + 1] - begin[s]
        of = np.repeat(np.arange(len(words)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, words[of] ^ self.patterns[excess][begin[s[of]] + nth]


def _copies(beyond: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosets = Cosets(beyond)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                prints = whole.column("print").slice(at, 4096).to_numpy(zero_copy_only=False).view(_U)
                low = (prints & _U((1 << N) - 1)).astype(np.int64)
                high = ((prints >> _U(N)) & _U((1 << N) - 1)).astype(np.int64)
                for a in range(beyond + 1):
                    of, first = cosets.codewords(low, a)
                    for b in range(beyond + 1 - a):
                        at2, second = cosets.codewords(high[of], b)
                        yield pa.RecordBatch.from_pydict({
                            "anchor": pa.array(first[at2] | (second << N)),
                            "print": pa.array(prints[of[at2]].view(np.int64)),
                            "home": pa.array(np.full(len(at2), a + b == 0))})
    return run


#: Comparisons of an anchor that are made without splitting it, and of a block.
DIRECT, BLOCK = 1 << 22, 1 << 20


def _candidates(home: np.ndarray, prints: np.ndarray, max_bits: int, direct: int,
                block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (one at home, another) that hold every pair within ``max_bits``."""
    at_home = np.flatnonzero(home)
    if len(at_home) * len(prints) <= direct:
        fields = [(0, 0)]                        # one field of no bits: all are alike
    else:
        cuts = np.linspace(0, 64, max_bits + 2).astype(int).tolist()
        fields = list(zip(cuts, np.diff(cuts).tolist()))
    for low, width in fields:
        value = (prints >> _U(low)) & _U((1 << width) - 1) if width < 64 else prints
        order = np.argsort(value, kind="stable")
        value = value[order]
        begin = np.searchsorted(value, value, side="left")
        count = np.searchsorted(value, value, side="right") - begin
        rows = np.flatnonzero(home[order])       # each meets its whole group
        upto = np.cumsum(count[rows])
        done = 0
        while done < len(rows):
            before = int(upto[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(upto, before + block, side="right")))
            own, n = rows[done:to], count[rows[done:to]]
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(order[own], n), order[np.repeat(begin[own], n) + nth]
            done = to


def forest(home: np.ndarray, prints: np.ndarray, max_bits: int, direct: int = DIRECT,
           block: int = BLOCK) -> list[tuple[int, int]]:
    """Spanning forest (indices) of the links between ``prints[home]`` and all ``prints``."""
    parent = np.arange(len(prints))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in _candidates(home, prints, max_bits, direct, block):
        near = np.flatnonzero(np.bitwise_count(prints[i] ^ prints[j]) <= max_bits)
        while len(near):
            i, j = i[near], j[near]
            top = parent
            while len(np.flatnonzero(top != top[top])):          # everyone's root
                top = top[top]
            parent = top.copy()
            apart = np.flatnonzero(parent[i] != parent[j])
            # one link of each pair of trees; the others follow when those are joined
            _, first = np.unique(np.minimum(parent[i[apart]], parent[j[apart]]) * len(prints)
                                 + np.maximum(parent[i[apart]], parent[j[apart]]), return_index=True)
            for k in apart[first].tolist():
                a, b = root(int(i[k])), root(int(j[k]))
                if a != b:
                    parent[b] = a
                    edges.append((int(i[k]), int(j[k])))
            near = apart if len(apart) > len(first) else apart[:0]
    return edges


def _compare(max_bits: int):
    def groups(batches: Iterator[pa.RecordBatch]):
        """(anchor, print, home) of whole anchors, from rows sorted by anchor."""
        kept: list[list[np.ndarray]] = []        # of the last anchor so far
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "print", "home")]
            if kept and now[0][-1] == kept[-1][0][-1]:
                kept.append(now)
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            kept.append([c[:cut] for c in now])
            yield [np.concatenate(c) for c in zip(*kept)]
            kept = [[c[cut:] for c in now]]
        if kept:
            yield [np.concatenate(c) for c in zip(*kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, prints, home in groups(batches):
            if not len(anchor):
                continue
            begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            end = np.append(begin[1:], len(anchor))
            homes = np.add.reduceat(home.astype(np.int64), begin)
            a, b = [], []
            for k in np.flatnonzero((end - begin > 1) & (homes > 0)):
                own = prints[begin[k]:end[k]]
                for i, j in forest(home[begin[k]:end[k]], own.view(_U), max_bits):
                    a.append(own[i])
                    b.append(own[j])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``print`` (distinct) -> ``a, b``: links that connect all within ``max_bits``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the anchors are made for thresholds of 0 to 3 bits")
    copies = prints.select("print").mapInArrow(_copies(max_bits), "anchor long, print long, home boolean")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = copies.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return near.mapInArrow(_compare(max_bits), "a long, b long")


def annotate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, print, component_id, root`` for every row; ids keep
    their type."""
    ship_package(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(f"`{text_col}`").alias("row_key"),
                        F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([given.schema["doc_id"], T.StructField("row_key", T.LongType()),
                        T.StructField("print", T.LongType())])
    rows = land(given.mapInArrow(_fingerprints(shingle), out), "fingerprints")
    nodes = land(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    stars = components(links(nodes, max_bits))
    placed = (nodes.join(stars, nodes["print"] == stars["node"], "left")
              .select("print", "least", F.coalesce("root", "print").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    names = placed.select("print", "root").join(named, "root")
    return rows.join(names, "print").select("doc_id", "row_key", "print", "component_id", "root")


def hexadecimal(column: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row of each component: that with the least id, with all its columns."""
    found = annotate(docs, shingle, max_bits, id_col, text_col)
    kept = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("one")))
    return pick(docs, kept.select(F.col("one.doc_id").alias(id_col), "one.row_key", F.lit(1).alias("copies")),
                "copies", id_col, text_col)
