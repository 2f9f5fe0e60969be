"""Row-local tokenising for ``features.encode`` (T3, T5) and its hook.

A tokenizer is any picklable callable ``(texts, max_length) -> list of id
lists``: special ids included, at most ``max_length`` long.  It runs inside the
Arrow batches of the rows' own tasks, so no row moves.  ``VocabTokenizer`` is
the one for a vocabulary table of whole words, ``SubwordTokenizer`` for one of
word pieces; both work on whole Arrow columns, and the distinct words of a
batch walk a trie (``trie.FlatTrie``) together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.md5 import md5_pairs, md5_words
from .trie import FlatTrie

# Reserved token ids (our own numbering).
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
SPECIAL_IDS = (PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID)
N_SPECIAL = len(SPECIAL_IDS)
#: Mark of a piece that continues a word.
CONTINUES = "##"
#: Longer words are unknown as a whole to ``SubwordTokenizer`` (as in word-piece tokenizers).
MOST_WORD_BYTES = 400
#: Ends of messages, for every size of a key, up to which ``token_digests`` writes them out.
MOST_TAILS = 1 << 14

Tokenizer = Callable[[Sequence[str], int], Sequence[Sequence[int]]]


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each space-separated word, and the words."""
    pieces = pc.split_pattern(pc.fill_null(column, ""), " ")
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.combine_chunks()
    row = np.repeat(np.arange(len(pieces)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    words = pieces.flatten()
    some = np.flatnonzero(pc.not_equal(words, "").to_numpy(zero_copy_only=False))
    return row[some], words.take(pa.array(some))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each value lies in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return np.frombuffer(raw if raw is not None else b"", dtype=np.uint8), offsets[:-1], offsets[1:]


def framed(ids: np.ndarray, row: np.ndarray, rows: int, max_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids by row, cut so that ``CLS`` and ``SEP`` fit around them; all ids, and each row's number."""
    first = np.searchsorted(row, np.arange(rows))
    nth = np.arange(len(row)) - first[row]
    fit = nth < max_length - 2
    ids, row, nth = ids[fit], row[fit], nth[fit]
    size = np.bincount(row, minlength=rows) + 2
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), CLS_ID, dtype=np.int32)
    out[begin[row] + 1 + nth] = ids
    out[begin + size - 1] = SEP_ID
    return out, size


class VocabTokenizer:
    """Space-separated tokens looked up in a vocabulary: ``[CLS] t1..tn [SEP]``,
    truncated so that both fit; tokens outside it are ``UNK``."""

    def __init__(self, trie: FlatTrie) -> None:
        self.trie = trie

    @classmethod
    def of(cls, tokens: Sequence[str], ids: Sequence[int]) -> VocabTokenizer:
        return cls(FlatTrie.build([t.encode() for t in tokens], np.zeros(len(tokens), dtype=np.int64), ids))

    def arrays(self, column: pa.Array, max_length: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        row, words = split_words(column)
        coded = words.dictionary_encode()
        found = self.trie.whole(*string_bytes(coded.dictionary))
        ids = np.where(found >= 0, found, UNK_ID)[coded.indices.to_numpy(zero_copy_only=False)]
        return framed(ids, row, len(column), max_length)

    def __call__(self, texts: Sequence[str], max_length: int) -> list[list[int]]:
        flat, size = self.arrays(pa.array(texts, pa.string()), max_length)
        return [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] if len(size) else []


class SubwordTokenizer:
    """``[CLS] p1..pn [SEP]`` with the longest pieces from the left; a word of
    which some place has no piece is one ``UNK``."""

    def __init__(self, trie: FlatTrie) -> None:
        self.trie = trie

    @classmethod
    def of(cls, tokens: Sequence[str], ids: Sequence[int]) -> SubwordTokenizer:
        # a word may itself begin with the mark, so marked pieces are known in both places
        inner = [(t[len(CONTINUES):], i) for t, i in zip(tokens, ids) if t.startswith(CONTINUES)]
        strings = [*tokens, *(t for t, _ in inner)]
        roots = np.concatenate([np.zeros(len(tokens), np.int64), np.ones(len(inner), np.int64)])
        return cls(FlatTrie.build([t.encode() for t in strings], roots, [*ids, *(i for _, i in inner)]))

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        data, start, end = string_bytes(column)
        n = len(start)
        at, bad = start.copy(), (end - start) > MOST_WORD_BYTES
        whose, ids = [], []
        open_, root = np.flatnonzero(~bad & (start < end)), 0
        while len(open_):
            found, to = self.trie.longest(data, at[open_], end[open_], root)
            bad[open_[found < 0]] = True
            open_, found, to = open_[found >= 0], found[found >= 0], to[found >= 0]
            whose.append(open_)
            ids.append(found)
            at[open_] = to
            open_, root = open_[to < end[open_]], 1
        whose = np.concatenate([*whose, np.flatnonzero(bad)]) if n else np.zeros(0, np.int64)
        ids = np.concatenate([*ids, np.full(int(bad.sum()), UNK_ID, np.int32)]) if n else np.zeros(0, np.int32)
        kept = ~bad[whose]
        kept[len(kept) - int(bad.sum()):] = True                 # one UNK each; its pieces so far go
        whose, ids = whose[kept], ids[kept]
        order = np.argsort(whose, kind="stable")                 # rounds are in order of the pieces
        return ids[order], np.bincount(whose, minlength=n)

    def arrays(self, column: pa.Array, max_length: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        rows = len(column)
        row, words = split_words(column)
        coded = words.dictionary_encode()
        flat, per_word = self.words(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        begin = np.cumsum(per_word) - per_word
        size = per_word[which]
        ends = np.cumsum(size)
        ids = flat[np.repeat(begin[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return framed(ids, np.repeat(row, size), rows, max_length)

    def __call__(self, texts: Sequence[str], max_length: int) -> list[list[int]]:
        flat, size = self.arrays(pa.array(texts, pa.string()), max_length)
        return [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] if len(size) else []


def _encoded(tokenizer: Tokenizer, column: pa.Array, max_length: int) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(tokenizer, (VocabTokenizer, SubwordTokenizer)):
        return tokenizer.arrays(column, max_length)
    ids = tokenizer(pc.fill_null(column, "").to_pylist(), max_length)
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    if len(ids) != len(column) or (len(size) and size.max() > max_length):
        raise ValueError("the tokenizer must give each text at most max_length ids")
    flat = np.fromiter((x for row in ids for x in row), dtype=np.int32, count=int(size.sum()))
    return flat, size


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                    pa.array(values, pa.int32()))


def _stacked(views: list[pa.ListArray], width: int | None) -> pa.ListArray:
    """Row by row, the lists of all views; ``width``: the size of every list, if they are alike."""
    n, k = len(views[0]), len(views)
    if width is not None:
        values = np.stack([v.values.to_numpy().reshape(n, width) for v in views], axis=1).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), _lists(values, np.full(n * k, width)))
    every = pa.concat_arrays(views)
    order = np.arange(n * k).reshape(k, n).T.reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), every.take(pa.array(order)))


def encoder(tokenizer: Tokenizer, views: Sequence[str], nested: bool, keys: Sequence[str], out_col: str,
            max_length: int, pad: bool, pad_id: int, with_masks: bool):
    """The batch function of ``encode``; a text column that several views name is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list[pa.ListArray]] = {}
            for view in dict.fromkeys(views):
                flat, size = _encoded(tokenizer, batch.column(view), max_length)
                width = np.full(len(size), max_length) if pad else size
                begin = np.cumsum(width) - width
                at = np.arange(len(flat)) + np.repeat(begin - (np.cumsum(size) - size), size)
                ids = np.full(int(width.sum()), pad_id, dtype=np.int32)
                ids[at] = flat
                columns = [_lists(ids, width)]
                if with_masks:
                    mask = np.zeros(len(ids), dtype=np.int32)
                    mask[at] = 1
                    columns += [_lists(mask, width), _lists(np.zeros(len(ids), dtype=np.int32), width)]
                made[view] = columns
            names = [out_col, "attention_mask", "token_type_ids"][:3 if with_masks else 1]
            out = {c: batch.column(c) for c in keys}
            for k, name in enumerate(names):
                out[name] = _stacked([made[v][k] for v in views], max_length if pad else None) if nested else made[views[0]][k]
            yield pa.RecordBatch.from_pydict(out)
    return run


def token_digests(keys: pa.Array, row: np.ndarray, view: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """MD5 words (n, 4) of ``key:view:pos`` for each token; ``key`` is that of its row."""
    data, start, end = string_bytes(keys)
    size = end - start
    # a row's tokens share its key, and tokens of one place the rest of the message
    width = int(pos.max(initial=0)) + 1
    place = view * width + pos
    known = np.flatnonzero(np.bincount(place))
    ends = [b":%d:%d" % divmod(int(p), width) for p in known]
    longest = max(map(len, ends), default=0)
    tail_size = np.array([len(e) for e in ends], dtype=np.int64)
    nth = np.zeros(int(known[-1]) + 1 if len(known) else 0, dtype=np.int64)
    nth[known] = np.arange(len(known))
    which = nth[place]
    at = np.repeat(np.arange(len(size)), size)
    head = np.zeros((len(size), max(64, int(size.max(initial=0)) + longest)), dtype=np.uint8)
    head[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = data[start[0]:end[-1]] if len(size) else 0
    sizes, kind = np.unique(size, return_inverse=True)
    if head.shape[1] == 64 and int(size.max(initial=0)) + longest < 56 and len(sizes) * len(ends) <= MOST_TAILS:
        # one block each: the rest of the message where keys of a size end, with the digest's end mark and length
        tails = np.zeros((len(sizes), len(ends), 64), dtype=np.uint8)
        for s, n in enumerate(sizes.tolist()):
            for k, e in enumerate(ends):
                tails[s, k, n:n + len(e) + 1] = np.frombuffer(e + b"\x80", dtype=np.uint8)
                tails[s, k, 56:] = np.frombuffer((8 * (n + len(e))).to_bytes(8, "little"), dtype=np.uint8)
        return md5_pairs(head, tails.reshape(-1, 64), row, kind[row] * len(ends) + which)
    tail = np.zeros((len(ends), longest), dtype=np.uint8)
    for k, e in enumerate(ends):
        tail[k, :len(e)] = np.frombuffer(e, dtype=np.uint8)
    messages = head[row]
    for j in range(longest):
        own = np.flatnonzero(tail_size[which] > j)
        messages[own, size[row[own]] + j] = tail[which[own], j]
    return md5_words(messages, size[row] + tail_size[which])


def masker(ids_col: str, special: Sequence[int], probability: float, mask_share: float, random_share: float,
           vocab_size: int, ignore: int, out_ids: str, out_labels: str, key_col: str, carry: Sequence[str]):
    """The batch function of ``mlm_mask``: one digest per token that is not special."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = batch.column(ids_col)
            inner = outer.flatten()
            ids = inner.flatten().to_numpy(zero_copy_only=False)
            per_view = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
            per_row = pc.fill_null(pc.list_value_length(outer), 0).to_numpy(zero_copy_only=False)
            view = np.arange(len(per_view)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            row_of_view = np.repeat(np.arange(len(per_row)), per_row)
            first = np.cumsum(per_view) - per_view
            drawn = np.flatnonzero(~np.isin(ids, special))
            of = np.repeat(np.arange(len(per_view)), per_view)[drawn]
            digests = token_digests(batch.column(key_col), row_of_view[of], view[of], drawn - first[of])
            picked = np.flatnonzero(digests[:, 0] / 4294967296.0 < probability)
            u = digests[picked, 1:] / 4294967296.0
            drawn = drawn[picked]
            old = ids[drawn]
            swapped = np.where(u[:, 1] < random_share, np.floor(u[:, 2] * vocab_size).astype(np.int32), old)
            ids_out, labels = ids.copy(), np.full(len(ids), ignore, dtype=np.int32)
            ids_out[drawn] = np.where(u[:, 0] < mask_share, MASK_ID, swapped)
            labels[drawn] = old
            rows = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
            out = {c: batch.column(c) for c in carry}
            for name, values in ((out_ids, ids_out), (out_labels, labels)):
                out[name] = pa.ListArray.from_arrays(rows, _lists(values, per_view))
            yield pa.RecordBatch.from_pydict(out)
    return run
