"""Public tokenizer files opened on workers, once per worker.

Names are resolved by ``public_tokenizers.path`` unless a folder is given, so
no vocabulary is part of this repository.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Pre-tokens remembered in each of two generations (about 120 bytes each), and
#: characters of the longest: a text without spaces is one long pre-token.
REMEMBERED, LONG = 400_000, 64

#: The public byte-level BPE split, for texts of characters below U+0250 only,
#: where letters, numbers and white space are these.  Texts with others (or
#: with control characters that libraries class differently) are encoded whole.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_SIMPLE = re.compile("[^\x1C-\x1F\u0250-\U0010FFFF]*")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes for themselves, the others numbered on from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    at = {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}
    return [chr(at[b]) for b in range(256)]


def file_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def version(name: str, folder: str | None = None) -> str:
    """SHA-256 of the tokenizer's file."""
    with open(file_path(name, folder), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def is_plain(file: dict) -> bool:
    """Whether a tokenizer file says what ``ByteLevelEncoder`` stands in for: no
    normaliser, the byte-level split as it is, and plain BPE merges."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    return (file.get("normalizer") is None and file.get("truncation") is None and file.get("padding") is None
            and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True)
            and split.get("use_regex", True) and model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and all(t.get("special") and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word")
                    for t in file.get("added_tokens") or []))


class Remembered(dict):
    """Ids of pre-tokens; one that is not there is taken from the generation
    before, or made, and remembered unless it is long."""

    def __init__(self, before: dict[str, bytes], make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.before, self.make = before.get, make

    def __missing__(self, piece: str) -> bytes:
        ids = self.before(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > LONG:
                return ids
        self[piece] = ids
        return ids


class ByteLevelEncoder:
    """``tokenizers`` encoding of whole texts, remembering pre-tokens.

    Byte-level BPE merges only inside a pre-token, so a text's ids are those
    of its pre-tokens in turn.  The library's model encodes each new one; ids
    are kept as little-endian 32-bit bytes, so a text is one join.  Texts for
    which the split could differ (see ``SPLIT``) or that hold an added special
    string are encoded whole by the library, and so is every text if the file
    says anything but that split and that model (``plain``).
    """

    def __init__(self, name: str, folder: str | None = None) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file_path(name, folder))
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(file_path(name, folder), encoding="utf-8") as f:
            self.plain = is_plain(json.load(f))
        self.characters = dict(enumerate(byte_characters()))
        self.young = Remembered({}, self._make)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def simple(self, text: str) -> bool:
        return _SIMPLE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _make(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters))
        if len(tokens) == 1:
            return tokens[0].id.to_bytes(4, "little")
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.plain:
            return self.whole(texts)
        out = []
        for text in texts:
            if not self.simple(text):
                out += self.whole([text])
                continue
            if len(self.young) > REMEMBERED:
                self.young.before = {}.get       # two generations, no more
                self.young = Remembered(self.young, self._make)
            out.append(b"".join(map(self.young.__getitem__, SPLIT.findall(text))))
        return out


@lru_cache(maxsize=2)
def byte_level(name: str, folder: str | None = None) -> ByteLevelEncoder:
    return ByteLevelEncoder(name, folder)


@lru_cache(maxsize=2)
def pieces(name: str, folder: str | None = None):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=file_path(name, folder))


def count_tokens(texts: list[str], name: str, folder: str | None = None) -> list[int]:
    """Tokens per text as the name's library gives them by default."""
    if name.endswith(".model"):
        return [len(ids) for ids in pieces(name, folder).encode(texts, num_threads=1)]
    return [len(ids) // 4 for ids in byte_level(name, folder).encode(texts)]
