"""MD5 of many short messages at once (RFC 1321), for draws in Arrow batches.

Messages are rows of a byte matrix; every step of the digest is one numpy
expression over all of them.  Messages are grouped by their number of 64-byte
blocks, so any length is allowed.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the algorithm: rotations of each round, and where a step reads its message.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_READS = ((1, 0), (5, 1), (3, 5), (7, 0))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Its constants by their rule: ``floor(2^32 |sin(i + 1)|)``.
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2 ** 32)) for i in range(64)]
#: Messages digested at a time, so that the working arrays stay in the cache.
_AT_ONCE = 1 << 15


def _block(state: list[np.ndarray], m: list[np.ndarray | None]) -> list[np.ndarray]:
    """The state after one more block of 16 words of each message; ``None``: a word that is zero in all."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        r = i >> 4
        if r == 0:                                  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif r == 1:                                # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif r == 2:                                # b ^ c ^ d
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:                                       # c ^ (b | ~d)
            np.invert(d, out=f)
            f |= b
            f ^= c
        step, first = _READS[r]
        word = m[(step * i + first) & 15]
        f += a
        if word is not None:
            f += word
        f += _SINES[i]
        turn = _TURNS[r][i & 3]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a               # the old ``a`` is the next step's room
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _start(n: int) -> list[np.ndarray]:
    return [np.full(n, x, dtype=np.uint32) for x in _START]


def _blocks(words: np.ndarray) -> np.ndarray:
    """Digests (n, 4) of padded messages (n, blocks * 16) of little-endian words."""
    state = _start(len(words))
    for at in range(0, words.shape[1], 16):
        state = _block(state, [np.ascontiguousarray(words[:, at + k]) for k in range(16)])
    return np.stack(state, axis=1)


def md5_pairs(heads: np.ndarray, tails: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """``md5_words`` of messages of one block, each the sum of a row of
    ``heads`` and a row of ``tails`` ((., 64) bytes; no place is set in both;
    the end mark and the length are the tail's)."""
    # word by word, as the digest reads them
    heads, tails = (np.ascontiguousarray(x.view("<u4").T) for x in (heads, tails))
    in_head, in_tail = heads.any(axis=1), tails.any(axis=1)
    out = np.empty((len(head), 4), dtype=np.uint32)
    for a in range(0, len(head), _AT_ONCE):
        h, t = head[a:a + _AT_ONCE], tail[a:a + _AT_ONCE]
        m: list[np.ndarray | None] = []
        for k in range(16):
            word = heads[k].take(h) if in_head[k] else None
            if in_tail[k]:
                word = tails[k].take(t) if word is None else word | tails[k].take(t)
            m.append(word)
        for k, x in enumerate(_block(_start(len(h)), m)):
            out[a:a + _AT_ONCE, k] = x.byteswap()
    return out


def md5_words(messages: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Four big-endian 32-bit words (n, 4) of the MD5 of each message, as its
    hexadecimal form prints them.  ``messages`` is (n, width) bytes, zero
    beyond each row's ``size``."""
    out = np.empty((len(size), 4), dtype=np.uint32)
    blocks = (size + 8) // 64 + 1
    for k in np.unique(blocks).tolist():
        every = np.flatnonzero(blocks == k)
        for a in range(0, len(every), _AT_ONCE):
            own = every[a:a + _AT_ONCE]
            padded = np.zeros((len(own), 64 * k), dtype=np.uint8)
            width = min(64 * k, messages.shape[1])
            padded[:, :width] = messages[own, :width]
            padded[np.arange(len(own)), size[own]] = 0x80
            padded[:, -8:] = (size[own].astype("<u8") * np.uint64(8)).view(np.uint8).reshape(-1, 8)
            out[own] = _blocks(padded.view("<u4")).byteswap()
    return out
