"""Strings in a flat trie, for looking up the words of a whole batch at once.

The arrays are built once, sent to the executors as a file and mapped by their
Python workers: a batch costs no more with two million strings than with a
thousand, and the workers of a machine share the pages.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession


class FlatTrie:
    """Strings with ids, two sets of them (roots 0 and 1), as three arrays:
    a hashed table of edges (parent and byte -> child) and the id of each node."""

    NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, child: np.ndarray, token: np.ndarray) -> None:
        self.keys, self.child, self.token = keys, child, token
        self.name: str | None = None

    @classmethod
    def build(cls, strings: Sequence[bytes], roots: Sequence[int], ids: Sequence[int]) -> FlatTrie:
        """Level by level; of equal strings the first id counts."""
        ids = np.asarray(ids, dtype=np.int32)
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        size = np.array([len(s) for s in strings], dtype=np.int64)
        start = np.cumsum(size) - size
        node = np.asarray(roots, dtype=np.int64)
        token = [np.full(2, -1, dtype=np.int32)]
        edges, children, nodes = [], [], 2
        open_ = np.flatnonzero(size > 0)
        depth = 0
        while len(open_):
            key = (node[open_] << 8) | data[start[open_] + depth]
            own, which = np.unique(key, return_inverse=True)
            edges.append(own.astype(np.uint64))
            children.append(nodes + np.arange(len(own)))
            node[open_] = nodes + which
            depth += 1
            ends = open_[size[open_] == depth][::-1]             # reversed: the first is written last
            level = np.full(len(own), -1, dtype=np.int32)
            level[node[ends] - nodes] = ids[ends]
            token.append(level)
            nodes += len(own)
            open_ = open_[size[open_] > depth]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.uint64)
        to = np.concatenate(children) if children else np.zeros(0, np.int64)
        bits = max(4, int(2 * len(edge)).bit_length())
        keys, child = np.full(1 << bits, cls.NONE), np.zeros(1 << bits, dtype=np.int32)
        at, left = cls._slot(edge, bits), np.arange(len(edge))
        while len(left):
            free = left[keys[at[left]] == cls.NONE]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            keys[at[won]], child[at[won]] = edge[won], to[won]
            left = left[keys[at[left]] != edge[left]]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        return cls(keys, child, np.concatenate(token))

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children of nodes by a byte each, -1 if there is none."""
        key = ((node.astype(np.int64) << 8) | byte).astype(np.uint64)
        mask = len(self.keys) - 1
        at = self._slot(key, mask.bit_length())
        out = np.full(len(key), -1, dtype=np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.child[at[open_[hit]]]
            open_ = open_[~hit & (there != self.NONE)]
            at[open_] = (at[open_] + 1) & mask
        return out

    def longest(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: none) and end of the longest string that begins at each ``start``."""
        best, best_end = np.full(len(start), -1, dtype=np.int32), start.copy()
        node, at = np.full(len(start), root, dtype=np.int64), start.copy()
        open_ = np.flatnonzero(at < end)
        while len(open_):
            to = self.step(node[open_], data[at[open_]])
            open_, to = open_[to >= 0], to[to >= 0]
            node[open_] = to
            at[open_] += 1
            found = self.token[to]
            hit = open_[found >= 0]
            best[hit], best_end[hit] = found[found >= 0], at[hit]
            open_ = open_[at[open_] < end[open_]]
        return best, best_end

    def whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, root: int = 0) -> np.ndarray:
        """Id of each slice as a whole, -1 if unknown."""
        found, to = self.longest(data, start, end, root)
        return np.where(to == end, found, -1)

    # the arrays travel as one file that workers map

    def send(self, spark: SparkSession) -> FlatTrie:
        """Give the arrays to every executor as a file (``addFile``); pickling then costs only its name."""
        name = f"trie-{uuid.uuid4().hex[:12]}.bin"
        path = os.path.join(tempfile.mkdtemp(prefix="sentspark-trie-"), name)
        with open(path, "wb") as f:
            f.write(np.array([len(self.keys), len(self.token)], dtype="<i8").tobytes())
            for x, kind in ((self.keys, "<u8"), (self.child, "<i4"), (self.token, "<i4")):
                f.write(np.ascontiguousarray(x, dtype=kind).tobytes())
        spark.sparkContext.addFile(path)
        self.name = name
        return self

    def __reduce__(self):
        if self.name is None:
            return FlatTrie, (self.keys, self.child, self.token)
        return mapped, (self.name,)


_MAPPED: dict[str, FlatTrie] = {}


def mapped(name: str) -> FlatTrie:
    """The trie of a sent file; each worker process maps it once."""
    if name not in _MAPPED:
        path = SparkFiles.get(name)
        slots, nodes = np.fromfile(path, dtype="<i8", count=2).tolist()
        at = lambda dtype, offset, n: np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=(n,))
        trie = FlatTrie(at("<u8", 16, slots), at("<i4", 16 + 8 * slots, slots), at("<i4", 16 + 12 * slots, nodes))
        trie.name = name
        _MAPPED[name] = trie
    return _MAPPED[name]
