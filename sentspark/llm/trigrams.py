"""Order 3 of the n-gram model: triples above the pairs of ``ngram_lm``.

Tasks reduce their triples (u, v, w) of word places to distinct ones with
counts, packed per shard.  A triple goes where its middle word lies (those of
hot middle words by their context (u, v)), so that a shard holds whole contexts
(u, v) and, but for hot words, all words u before a pair (v, w).  A text's
first word has the start as middle word and nothing before it; it goes by
itself, as a pair.  The counts are exact: keys are the words' places, not
hashes.  Each shard becomes one file of arrays:

* contexts seen once: u and the word that follows, by middle word;
* other contexts: u, counts, and what follows, by middle word; counts are
  bytes, with those of 255 and more in a list of their own;
* pairs, by hash: how many different words lie before them (continuation
  counts, from which the middle order is made; after the start, plain counts).

A second, small exchange adds up the pairs of hot words.  Both stages tell the
words' shards in how many pairs each word is the second, from which the lowest
order is made: no pass over the texts counts pairs alone.

Defined cases: the first word of a text has the start context alone and is
scored by the pairs' counts; a context never seen leaves all to the pairs.
The other cases are those of ``ngram_lm``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import ngram_lm as lm
from . import textkernel as tk
from .warc import filesystem

_U = np.uint64
TRIPLE_ROW = "shard int, n long, a binary, b binary, c binary, d binary"
_SUMS = ("sum", "one", "two", "more")


# ---- files of several arrays ------------------------------------------------

def store(folder: str, kind: str, shard: int, arrays: dict[str, np.ndarray]) -> tuple[str, str]:
    """One file of arrays, each in the least type that holds it; its path, and
    where each array lies as JSON."""
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    name = f"{kind}-{shard:05d}-{uuid.uuid4().hex[:8]}"
    layout, at = {}, 0
    with fs.open_output_stream(f"{inner}/{name}", compression=None) as out:
        for key, x in arrays.items():
            dtype = np.min_scalar_type(int(x.max()) if len(x) else 0).newbyteorder("<")
            x = np.ascontiguousarray(x.astype(dtype))
            layout[key] = (at, dtype.str, len(x))
            fill = -x.nbytes % 8
            out.write(x.tobytes() + bytes(fill))
            at += x.nbytes + fill
    return f"{folder}/{name}", json.dumps(layout)


def small(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 and more beside them."""
    big = np.flatnonzero(x >= 255)
    return {name: np.minimum(x, 255), f"{name}_at": big, f"{name}_big": x[big]}


class Opened:
    """The arrays of one file, mapped where that can be."""

    def __init__(self, path: str, layout: str) -> None:
        fs, inner = filesystem(path)
        if isinstance(fs, pafs.LocalFileSystem):
            self.data = np.memmap(inner, dtype=np.uint8, mode="r")
        else:
            with fs.open_input_stream(inner) as f:
                self.data = np.frombuffer(f.read(), dtype=np.uint8)
        self.layout = json.loads(layout)

    def __getitem__(self, name: str) -> np.ndarray:
        at, dtype, n = self.layout[name]
        return np.asarray(self.data)[at:at + n * np.dtype(dtype).itemsize].view(dtype)

    def small(self, name: str, at: np.ndarray) -> np.ndarray:
        x = self[name][at].astype(np.int64)
        big = np.flatnonzero(x == 255)
        if len(big):
            x[big] = self[f"{name}_big"][np.searchsorted(self[f"{name}_at"], at[big])]
        return x


def within(array: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each ``x`` in the sorted run ``array[low:high]``, -1 if absent."""
    out = np.full(len(x), -1, dtype=np.int64)
    on = np.flatnonzero(low < high)
    lo, hi, want = low[on].astype(np.int64), high[on].astype(np.int64), x[on].astype(np.int64)
    while len(on):                               # only searches that go on are kept
        mid = (lo + hi) >> 1
        there = array[mid]
        hit = there == want
        out[on[hit]] = mid[hit]
        less = there < want
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        keep = np.flatnonzero((lo < hi) & ~hit)
        on, lo, hi, want = on[keep], lo[keep], hi[keep], want[keep]
    return out


# ---- counting ---------------------------------------------------------------

def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns (the first leads) and where each distinct row begins in it."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) <= 64:                          # one sort of packed rows
        key = np.zeros(len(columns[0]), dtype=_U)
        for c, b in zip(columns, bits):
            key = (key << _U(b)) | c.astype(_U) if b < 64 else c.astype(_U)
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def stairs(*columns: np.ndarray) -> list[np.ndarray]:
    """Columns of sorted rows as differences to the row before, in each column
    as long as the columns to its left stay the same; else the value itself."""
    out = []
    same = np.ones(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        c = c.astype(_U)
        step = c.copy()
        step[1:] -= np.where(same, c[:-1], _U(0))
        out.append(step)
        same = same & (c[1:] == c[:-1])
    return out


def climbed(*steps: np.ndarray) -> list[np.ndarray]:
    """The columns of ``stairs``."""
    out = []
    new = np.zeros(len(steps[0]), dtype=bool)    # where a value stands for itself
    new[:1] = True
    for d in steps:
        total = np.cumsum(d, dtype=_U)
        at = np.flatnonzero(new)
        # what came before a run of differences is taken off again
        c = total - np.repeat(np.concatenate([[_U(0)], total[at[1:] - 1]]), np.diff(np.append(at, len(d)))) if len(d) else d
        out.append(c)
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
    return out


def before(first: np.ndarray, start: int) -> np.ndarray:
    """The place before each first word (of use only where that is no start)."""
    return np.concatenate([[start], first[:-1]]).astype(first.dtype)


def home_of_start(second: np.ndarray, start: int, shards: int) -> np.ndarray:
    """Shard of the pairs of the start context, by the whole pair."""
    return (lm.pair_key(np.full(len(second), start), second) % _U(shards)).astype(np.int64)


def _count(held_vocabulary, hot: np.ndarray, shards: int):
    def flush(held) -> Iterator[pa.RecordBatch]:
        start = held_vocabulary.value.size
        v, w = lm._pairs(held, held_vocabulary.value)
        u = np.where(v == start, start + 1, before(v, start))
        order, new = distinct(v, u, w)
        n = np.diff(np.append(new, len(order)))
        u, v, w = (x[order[new]] for x in (u, v, w))
        shard = lm.pair_shard(v, lm.pair_key(u, v), hot, shards)
        first = int(np.searchsorted(v, start))   # sorted: the start comes last
        shard[first:] = home_of_start(w[first:], start, shards)
        order, cut = lm.by_shard(shard, shards)
        for s in range(shards):
            own = order[cut[s]:cut[s + 1]]
            if len(own):
                blobs = [lm.pack(x) for x in stairs(v[own], u[own], w[own])] + [lm.pack(n[own].astype(_U))]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([s], pa.int32()), "n": pa.array([len(own)], pa.int64()),
                    **{c: pa.array([x], pa.binary()) for c, x in zip("abcd", blobs)}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for whole in batches:
            for batch in tk.chunks(lm._training(whole), "text"):
                held.append(lm._tokens(batch))
                size += len(held[-1][0])
                if size >= lm.FLUSH_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


_NUMBERS = [*(f"{x}{k}" for x in "nc" for k in (1, 2, 3, 4)), "s1", "s2", "s3"]
#: Kinds of rows: a shard's file, pairs of hot words for their shards, second words for theirs.
FILE, HOT, SECOND = 0, 1, 2
_FILE_ROW = ("shard int, kind int, path string, layout string, " + ", ".join(f"{x} long" for x in _NUMBERS)
             + ", n long, a binary, b binary, c binary, d binary")
_FILE_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("path", pa.string()), ("layout", pa.string()),
                         *((x, pa.int64()) for x in _NUMBERS), ("n", pa.int64()), *((c, pa.binary()) for c in "abcd")])


def _of_counts(name: str, x: np.ndarray) -> dict[str, int]:
    return {f"{name}{k}": int((x == k).sum()) for k in (1, 2, 3, 4)}


def _seconds(words: np.ndarray, base: np.ndarray) -> Iterator[dict]:
    """Rows for the words' shards: in how many of these pairs each word is the second."""
    places, count = np.unique(words, return_counts=True)
    cut = np.searchsorted(places, base)
    for s in range(len(base) - 1):
        own = slice(cut[s], cut[s + 1])
        if cut[s + 1] > cut[s]:
            yield {"shard": s, "kind": SECOND, "n": int(cut[s + 1] - cut[s]),
                   "a": lm.pack(lm.deltas(places[own].astype(_U))), "b": lm.pack(count[own].astype(_U))}


def _runs(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``head``."""
    return np.add.reduceat(x.astype(np.int64), head) if len(head) else np.zeros(0, dtype=np.int64)


def _merge(folder: str, base: np.ndarray, hot: np.ndarray, shards: int):
    """The shard's file, pairs of hot words for their shards, and second words for theirs."""
    start = int(base[-1])

    def run(table: pa.Table) -> pa.Table:
        parts = [(*climbed(*(lm.unpack(r[c], r["n"]) for c in "abc")), lm.unpack(r["d"], r["n"]))
                 for r in table.to_pylist()]
        shard = table.column("shard")[0].as_py()
        v, u, w, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        del parts
        order, new = distinct(v, u, w)
        n = np.add.reduceat(n[order], new)
        v, u, w = (x[order[new]] for x in (v, u, w))
        # pairs of the start context lie at the end
        first = int(np.searchsorted(v, start))
        begun, begun_n = w[first:], n[first:]
        v, u, w, n = (x[:first] for x in (v, u, w, n))
        # contexts (v, u), each a run of triples
        same = np.ones(len(v), dtype=bool)
        same[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        head = np.flatnonzero(same)
        total = _runs(n, head)
        mid = np.unique(v)
        once = np.flatnonzero(total == 1)
        many = np.flatnonzero(total > 1)
        length = np.diff(np.append(head, len(v)))
        rest = np.repeat(total > 1, length)
        place = lambda x: np.concatenate([np.searchsorted(x, mid), [len(x)]])
        kept = {"mid": mid, "once_off": place(v[head[once]]), "once_u": u[head[once]], "once_w": w[head[once]],
                "many_off": place(v[head[many]]), "many_u": u[head[many]],
                "runs": np.concatenate([[0], np.cumsum(length[many])]), "w": w[rest], **small("n", n[rest]),
                **small("total", total[many])}
        for name, x in zip(_SUMS[1:], (n == 1, n == 2, n >= 3)):
            kept |= small(name, _runs(x, head)[many])
        counts = _of_counts("n", n)
        # how many words lie before each pair (v, w)
        order, new = distinct(v, w)
        pv, pw, left = v[order[new]], w[order[new]], np.diff(np.append(new, len(order)))
        key = lm.pair_key(pv, pw)
        far = np.isin(pv, hot)
        near = ~far
        at = np.searchsorted(mid, pv[near])
        for name, x in zip(_SUMS, (left[near], left[near] == 1, left[near] == 2, left[near] >= 3)):
            kept[f"v_{name}"] = np.bincount(at, weights=x, minlength=len(mid)).astype(np.int64)
        own = np.concatenate([key[near], lm.pair_key(np.full(len(begun), start), begun)])
        order = np.argsort(own)
        kept |= {"keys": own[order]} | small("left", np.concatenate([left[near], begun_n])[order])
        path, layout = store(folder, "triples", shard, kept)
        rows = [{"shard": shard, "kind": FILE, "path": path, "layout": layout, **counts, **_of_counts("c", left[near]),
                 "s1": int((begun_n == 1).sum()), "s2": int((begun_n == 2).sum()), "s3": int((begun_n >= 3).sum())}]
        rows += _seconds(np.concatenate([pw[near], begun]), base)
        home = (key[far] % _U(shards)).astype(np.int64)
        order = np.lexsort((key[far], home))
        cut = np.searchsorted(home[order], np.arange(shards + 1))
        for s in range(shards):
            some = order[cut[s]:cut[s + 1]]
            if len(some):
                rows.append({"shard": s, "kind": HOT, "n": len(some), "a": lm.pack(lm.deltas(key[far][some])),
                             **{c: lm.pack(x[far][some].astype(_U)) for c, x in (("b", left), ("c", pv), ("d", pw))}})
        return pa.Table.from_pylist(rows, _FILE_ARROW)
    return run


_HOT_ROW = ("shard int, kind int, path string, layout string, v long, sum long, one long, two long, more long, "
            "c1 long, c2 long, c3 long, c4 long, n long, a binary, b binary")
_HOT_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("path", pa.string()), ("layout", pa.string()),
                        *((x, pa.int64()) for x in ("v", *_SUMS, "c1", "c2", "c3", "c4", "n")),
                        ("a", pa.binary()), ("b", pa.binary())])


def _merge_hot(folder: str, base: np.ndarray):
    """Continuation counts of the pairs of hot words in a shard, sums by first
    word, and second words for their shards."""
    def run(table: pa.Table) -> pa.Table:
        parts = [(lm.undo(lm.unpack(r["a"], r["n"])), *(lm.unpack(r[c], r["n"]) for c in "bcd"))
                 for r in table.to_pylist()]
        shard = table.column("shard")[0].as_py()
        key, left, v, w = (np.concatenate(x) for x in zip(*parts))
        order, new = distinct(key)
        left = np.add.reduceat(left[order].astype(np.int64), new)
        key, v, w = key[order[new]], v[order[new]].astype(np.int64), w[order[new]].astype(np.int64)
        path, layout = store(folder, "hot", shard, {"keys": key} | small("left", left))
        rows = [{"shard": shard, "kind": FILE, "path": path, "layout": layout, **_of_counts("c", left)}]
        words, at = np.unique(v, return_inverse=True)
        sums = [np.bincount(at, weights=x).astype(np.int64) for x in (left, left == 1, left == 2, left >= 3)]
        rows += [{"shard": -1, "kind": HOT, "v": int(x), **{name: int(s[k]) for name, s in zip(_SUMS, sums)}}
                 for k, x in enumerate(words)]
        rows += _seconds(w, base)
        return pa.Table.from_pylist(rows, _HOT_ARROW)
    return run


# ---- model ------------------------------------------------------------------

@dataclass
class Triples:
    """Files of the shards (``None``: empty) and what is known of hot words."""

    files: list[tuple[str, str] | None]
    hot_files: list[tuple[str, str] | None]
    hot: np.ndarray                  # places, sorted
    hot_sums: np.ndarray             # by row of ``hot``: sum, one, two, more
    pair_discounts: np.ndarray
    discounts: np.ndarray

    def contexts(self, m: lm.Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words at these places (the last is the start): what the middle
        order's counts after each add up to, and the share left for the lower order."""
        size, shards = m.vocabulary.size, m.vocabulary.shards
        sums = np.zeros((len(words), 4), dtype=np.int64)
        sums[-1] = [m.documents, *m.start]
        inner = np.flatnonzero((words >= 0) & (words < size))
        hot = np.isin(words[inner], self.hot)
        sums[inner[hot]] = self.hot_sums[np.searchsorted(self.hot, words[inner[hot]])]
        inner = inner[~hot]
        order, cut = lm.by_shard((tk.mix64(words[inner].astype(_U)) % _U(shards)).astype(np.int64), shards)
        for s in range(shards):
            own = inner[order[cut[s]:cut[s + 1]]]
            if len(own) and self.files[s]:
                file = Opened(*self.files[s])
                own = own[np.argsort(words[own])]
                k = lm.find(file["mid"], words[own])
                own, k = own[k >= 0], k[k >= 0]
                for j, name in enumerate(_SUMS):
                    sums[own, j] = file[f"v_{name}"][k]
        total = sums[:, 0]
        return total, np.where(total > 0, (sums[:, 1:] @ self.pair_discounts[1:]) / np.maximum(total, 1), 1.0)

    def middle(self, m: lm.Model, words: np.ndarray, f: np.ndarray, s: np.ndarray) -> np.ndarray:
        """p(second | first) of the middle order, of distinct pairs; ``f`` and
        ``s`` number ``words``, places of which the last is the start."""
        size, shards = m.vocabulary.size, m.vocabulary.shards
        total, mass = self.contexts(m, words)
        left = np.zeros(len(f), dtype=np.int64)
        pair = np.flatnonzero((total[f] > 0) & (words[s] >= 0))
        first, second = words[f[pair]], words[s[pair]]
        begin = first == size
        hot = np.isin(first, self.hot) & ~begin
        key = lm.pair_key(first, second)
        home = lm.pair_shard(first, key, m.hot, shards)
        home[begin] = home_of_start(second[begin], size, shards)
        order, cut = lm.by_shard(home, shards)
        for k in range(shards):
            own = order[cut[k]:cut[k + 1]]
            if not len(own):
                continue
            own = own[np.argsort(key[own])]
            for entry, at in ((self.files[k], own[~hot[own]]), (self.hot_files[k], own[hot[own]])):
                if entry and len(at):
                    file = Opened(*entry)
                    j = lm.find(file["keys"], key[at])
                    left[pair[at[j >= 0]]] = file.small("left", j[j >= 0])
        d, n = self.pair_discounts, np.maximum(total, 1)[f]
        return np.maximum(left - d[np.minimum(left, 3)], 0) / n + mass[f] * m.lower(words[:-1])[s]

    def log10(self, m: lm.Model, first, second, index, sizes_first, lower) -> np.ndarray:
        """log10 p(token | the two before it).  ``first, second`` are distinct
        pairs of places, ``index`` each token's pair, ``sizes_first`` its first
        word and ``lower`` its probability by the pair alone."""
        size, shards = m.vocabulary.size, m.vocabulary.shards
        out = lower.copy()
        token = np.flatnonzero(sizes_first != size)
        if not len(token):
            return np.log10(out)
        context = index[token - 1]             # the pair before a token is its context
        good = (first[context] >= 0) & (second[context] >= 0)
        token, context = token[good], context[good]
        rank = np.zeros(len(first), dtype=np.int64)
        rank[context] = 1
        used = np.flatnonzero(rank)
        rank[used] = np.arange(len(used))
        which = rank[context]
        u, v = first[used], second[used]
        shard = lm.pair_shard(v, lm.pair_key(u, v), m.hot, shards)
        order, cut = lm.by_shard(shard[which], shards)
        by, cut_by = lm.by_shard(shard, shards)
        place = np.empty(len(used), dtype=np.int64)
        d = self.discounts
        word = second[index[token]]
        for s in range(shards):
            own = by[cut_by[s]:cut_by[s + 1]]
            if not len(own) or not self.files[s]:
                continue
            f = Opened(*self.files[s])
            own = own[np.lexsort((u[own], v[own]))]
            mid = lm.find(f["mid"], v[own])
            low = {x: np.where(mid >= 0, f[x][np.maximum(mid, 0)], 0) for x in ("once_off", "many_off")}
            high = {x: np.where(mid >= 0, f[x][np.maximum(mid, 0) + 1], 0) for x in ("once_off", "many_off")}
            once = within(f["once_u"], low["once_off"], high["once_off"], u[own])
            many = within(f["many_u"], low["many_off"], high["many_off"], u[own])
            total = np.zeros(len(own))
            mass = np.ones(len(own))
            begin, end = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            only = np.full(len(own), -2, dtype=np.int64)
            hit = once >= 0
            total[hit], mass[hit], only[hit] = 1.0, d[1], f["once_w"][once[hit]]
            hit = np.flatnonzero(many >= 0)
            k = many[hit]
            total[hit] = f.small("total", k)
            mass[hit] = sum(d[j] * f.small(x, k) for j, x in enumerate(_SUMS[1:], 1)) / total[hit]
            begin[hit], end[hit] = f["runs"][k], f["runs"][k + 1]
            place[own] = np.arange(len(own))
            mine = order[cut[s]:cut[s + 1]]
            c = place[which[mine]]
            n = (only[c] == word[mine]).astype(np.int64)
            k = within(f["w"], begin[c], end[c], word[mine])
            n[k >= 0] = f.small("n", k[k >= 0])
            seen = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total[c], 1)
            out[token[mine]] = seen + mass[c] * lower[token[mine]]
        return np.log10(out)


def train(rows: DataFrame, vocabulary: lm.Vocabulary, hot: np.ndarray, held_vocabulary
          ) -> tuple[Triples, DataFrame, list[int], list[str]]:
    """Triples of the texts of ``rows``; rows that tell in how many pairs each
    word is the second; how many words begin texts once, twice and more often;
    and folders to drop when those rows have been read."""
    spark = rows.sparkSession
    shards, hot = vocabulary.shards, np.sort(hot)
    folder = scratch_path(spark, "ngram-triples")
    landed = scratch_path(spark, "ngram-triple-rows")
    (rows.mapInArrow(_count(held_vocabulary, hot, shards), TRIPLE_ROW).groupBy("shard")
     .applyInArrow(_merge(folder, vocabulary.base, hot, shards), _FILE_ROW).write.parquet(landed))
    made = spark.read.schema(_FILE_ROW).parquet(landed)
    files = {r.shard: r for r in made.where(f"kind = {FILE}").drop("a", "b", "c", "d").collect()}   # one row a shard
    again = scratch_path(spark, "ngram-hot-rows")
    (made.where(f"kind = {HOT}").select("shard", "n", "a", "b", "c", "d").groupBy("shard")
     .applyInArrow(_merge_hot(folder, vocabulary.base), _HOT_ROW).write.parquet(again))
    found = spark.read.schema(_HOT_ROW).parquet(again)
    hot_files = {r.shard: r for r in found.where(f"kind = {FILE}").drop("a", "b").collect()}
    sums = np.zeros((len(hot), 4), dtype=np.int64)
    for r in found.where(f"kind = {HOT}").groupBy("v").agg(*[F.sum(x).alias(x) for x in _SUMS]).collect():  # hot words
        sums[np.searchsorted(hot, r.v)] = [r[x] for x in _SUMS]
    at = lambda f: [(f[s].path, f[s].layout) if s in f else None for s in range(shards)]
    both = [*files.values(), *hot_files.values()]
    triples = Triples(at(files), at(hot_files), hot, sums,
                      lm.discounts(*(sum(r[f"c{k}"] for r in both) for k in (1, 2, 3, 4))),
                      lm.discounts(*(sum(r[f"n{k}"] for r in files.values()) for k in (1, 2, 3, 4))))
    seconds = [x.where(f"kind = {SECOND}").select("shard", "n", F.lit(0).alias("kind"), "a", "b") for x in (made, found)]
    return (triples, seconds[0].unionByName(seconds[1]), [sum(r[f"s{k}"] for r in files.values()) for k in (1, 2, 3)],
            [landed, again])
