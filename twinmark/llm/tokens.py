"""Cached access to published tokenizer files inside tasks."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Characters for which the fast path below is exact: no combining marks, stable under NFC, the same
#: classes in every Unicode version.  Any other text goes through the tokenizers library as a whole.
PLAIN = "[^\x00-įı-ɏ‐-‧€]"
BLANK, OTHER = r"\p{White_Space}", r"\P{White_Space}"
#: Entries that a worker keeps at most; the cache is emptied when it is full.
CACHE = 500_000


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others, in order, for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteTokens(dict):
    """ids of a byte-level vocabulary, by piece of text, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.odd = regex.compile(PLAIN).search
        self.cut = regex.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|{BLANK}+(?!{OTHER})|{BLANK}+""").findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = np.array(self.piece(piece.encode()), "<u4").tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.odd(text) or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.cut(text)))


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One per worker and file; workers are reused, so the cache outlives a task."""
    return ByteTokens(path)
