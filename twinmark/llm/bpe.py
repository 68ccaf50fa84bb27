"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton finds the longest token at every place of a piece of text.  Tokens are taken
from left to right, longest first; a token may follow another only if the pair is compatible, that is if
no merge across their seam would have come before the merges that made the two.  If nothing fits, the
last token is given up for its next shorter prefix, and the place is marked dead so that it is tried
only once.  The result is exactly that of applying all merges in order, in linear time.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import BLANK, PLAIN, byte_letters

#: Stands for the word-end suffix inside pieces; no byte-level letter is a line feed.
END = "\n"
#: Pieces, and pairs of tokens, that a worker remembers at most.
CACHE = 250_000


class Vocabulary:
    """Tokens of a byte-level BPE file with a word-end suffix: automaton, merge pairs and splits."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, ids = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        own = lambda t: t[:-len(suffix)] + END if t.endswith(suffix) else t
        self.id = {own(t): i for t, i in ids.items()}
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.rank, self.left, self.right, self.length = [-1] * size, [0] * size, [0] * size, [0] * size
        self.merged: dict[int, int] = {}  # left id * size + right id -> id
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = own(a), own(b)
            i, j, both = self.id[a], self.id[b], self.id[a + b]
            self.rank[both], self.left[both], self.right[both] = r, i, j
            self.merged[i * size + j] = both
        self.size = size
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for t, i in self.id.items():
            self.length[i] = len(t)
            self.automaton.add_word(t, (len(t), i))
            self.shorter[i] = next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.letters = {b: c for c, b in byte_letters().items()}

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` can stand side by side; found once for each pair.

        The two are taken apart again, latest merge first.  A merge of what meets at the seam breaks the
        pair if it comes before the merges that took its two sides into larger tokens; of two merges of
        equal rank the left one comes first.
        """
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, merged = self.rank, self.merged
        never = len(rank)
        above_a, above_b, fits = never, never, True
        while True:
            over = merged.get(a * self.size + b)
            if over is not None and rank[over] < above_a and rank[over] <= above_b:
                fits = False
                break
            if rank[a] > rank[b]:
                above_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                above_b, b = rank[b], self.left[b]
            else:
                break
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        """ids of one pre-token, written in byte-level letters and without its end mark."""
        piece += END
        n = len(piece)
        whole = self.id.get(piece)
        longest = [-1] * (n + 1)
        for end, (size, i) in self.automaton.iter(piece):
            longest[end - size + 1] = i  # ends come in order, so the longest is written last
        dead, out, at, token = [False] * (n + 1), [], 0, longest[0] if whole is None else whole
        length, shorter = self.length, self.shorter
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and (dead[at + length[token]] or (last >= 0 and not self.compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
                if token < 0 and at < n:
                    dead[at] = True
                    token = out.pop()
                    at -= length[token]
            else:
                dead[at] = True
                token = out.pop()
                at -= length[token]
        return out


class Offsets:
    """The texts of all tokens in one run of bytes, a blank behind each, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t.encode() for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        shown = [names.get(i, b"") + b" " for i in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in shown])))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts, joined by blanks: one gather over the bytes."""
        which = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(which):
            return b""
        start = self.starts[which]
        size = self.starts[which + 1] - start
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1]) + np.repeat(start - ends + size, size)][:-1].tobytes()


class Encoder(dict):
    """ids by lower-case piece, as little-endian unsigned 32-bit integers; pieces are encoded once per worker."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocabulary = Vocabulary(path)
        with open(path, encoding="utf-8") as f:
            self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"]}
        self.around = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split
        self.odd = regex.compile(PLAIN).search
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+").findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        letters = self.vocabulary.letters
        ids = np.array(self.vocabulary.encode_piece("".join([letters[b] for b in piece.encode()])), "<u4").tobytes()
        self[piece] = ids
        return ids

    def _part(self, text: str) -> bytes:
        if not self.odd(text):
            return b"".join(map(self.__getitem__, self.cut(text.lower())))
        letters = byte_letters()  # other characters: normalised and split by the file's own rules
        found = (bytes(letters[c] for c in p).decode() for p, _ in self.split(self.normalize(text)))
        return b"".join(map(self.__getitem__, found))

    def encode(self, text: str) -> bytes:
        parts = self.around(text) if "<" in text else [text]
        return b"".join(self.added[p] if p in self.added else self._part(p) for p in parts if p)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and file; workers are reused, so its cache outlives a task."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (binary: little-endian unsigned 32-bit integers).

    Null and empty texts have no ids; a null id is kept; repeated rows each get a row; an empty table
    gives an empty result; other columns are not read.
    """
    def run(batches):
        encode = encoder(path).encode
        for batch in slices(batches):
            ids = [encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the text of the ids, as UTF-8 bytes."""
    def run(batches):
        decode = Offsets(path).decode
        for batch in slices(batches):
            texts = [decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
