"""Arrow-batched pandas UDFs around ``pyhelpers`` (the slow path, used only where no built-in fits)."""

from __future__ import annotations

from collections import Counter
from typing import Callable, Iterator, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pyhelpers as H


@F.pandas_udf(T.LongType())
def longest_match_size_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([H.longest_match_size(x, y) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.LongType())
def lzma_len_udf(s: pd.Series) -> pd.Series:
    return pd.Series([H.lzma_len(x) for x in s], dtype="int64")


@F.pandas_udf(T.LongType())
def lzma_pair_len_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """min(len(C(a+b)), len(C(b+a)))."""
    return pd.Series([min(H.lzma_len(x + y), H.lzma_len(y + x)) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    from .snowball_es import stem
    return words.map(stem)


@F.pandas_udf(T.LongType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([H.partial_ratio(x, y) for x, y in zip(a, b)], dtype="int64")


def _matrices(lists: pa.Array):
    """The vectors of each row, a list of vectors, as a matrix in double precision, one row after the other."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
    vectors = lists.flatten()
    wide = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    starts = np.concatenate(([0], np.cumsum(np.maximum(wide, 0))))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    for row, (a, b) in enumerate(zip(ends, ends[1:])):
        width = wide[a] if a < b else 0
        if width >= 0 and (wide[a:b] == width).all():
            yield flat[starts[a]:starts[b]].reshape(b - a, width).astype(np.float64)
        else:
            yield np.array(lists[row].as_py(), np.float64)


def _doubles(rows: list, per_row: list) -> pa.Array:
    """Lists of doubles, one behind the other in ``rows``, of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))), pa.int32()), pa.array(np.concatenate([np.zeros(0), *rows])))


def dot_matrices(a: pa.Array, b: pa.Array) -> pa.Array:
    """All dot products of two lists of vectors, in double precision."""
    cells, high, wide = [], [], []
    for x, y in zip(_matrices(a), _matrices(b)):
        cells.append((x @ y.T).ravel() if len(x) and len(y) else np.zeros(0))
        high.append(len(x))
        wide.extend([len(y)] * len(x))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(high))), pa.int32()), _doubles(cells, wide))


VECTOR = T.ArrayType(T.DoubleType())
MATRIX = T.ArrayType(VECTOR)


def _row(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BAG = "shared long, total long, sum1 double, sum2 double, n1 long, n2 long, side array<int>, word array<string>, tf array<long>"


def bag_udf(idf=None, rare: bool = False, stops=()):
    """Word counts of two lower-cased texts without stop words, and their tf * idf sums, as a row of ``BAG``.

    ``str.split`` is the rule of ``text.tokens_ws``.

    ``idf`` is a broadcast {word: idf}; with ``rare``, words that are not in it are listed by side with their counts.
    """
    stops = frozenset(stops)

    @F.pandas_udf(BAG)
    def bag(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        weights = idf.value if idf is not None else {}
        out = []
        for texts in zip(a, b):
            bags = [Counter(x.split()) for x in texts]
            for c in bags:
                for w in stops & c.keys():
                    del c[w]
            one, two = bags
            shared = sum(one[w] + two[w] for w in one.keys() & two.keys())
            sums = [float(sum(n * weights.get(w, 0.0) for w, n in c.items())) for c in bags]
            rest = [(i, w, n) for i, c in enumerate(bags, 1) for w, n in c.items() if w not in weights] if rare else []
            out.append((shared, one.total() + two.total(), *sums, len(one), len(two), [r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest]))
        return pd.DataFrame(out, columns=["shared", "total", "sum1", "sum2", "n1", "n2", "side", "word", "tf"])

    return bag


#: Rows whose tokens are numbered together.
GRAM_ROWS = 200


def ngram_jaccard_udf(orders):
    """Jaccard of the n-grams (``grams.ngrams``) of two token lists, joined by blanks, for each order.

    The tokens of some rows at a time are numbered, and n-grams compared as numbers where these fit in 63 bits.
    """
    @F.arrow_udf(VECTOR)
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for at in range(0, len(a), GRAM_ROWS):
            sides = [pc.fill_null(s.slice(at, GRAM_ROWS), "") for s in (a, b)]
            rows, joined = len(sides[0]), pa.concat_arrays(sides)
            lists = pc.split_pattern(joined, " ")
            tokens = lists.flatten().dictionary_encode()
            base = len(tokens.dictionary)
            if base ** max(orders) < 2 ** 63:
                ids, starts = tokens.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
                ends = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), starts[:-1], starts[1:])
                of = [ids[i:j] for i, j in zip(starts, ends)]
                out.extend(np.array([H.ngram_jaccard_ids(x, y, base, n) for n in orders]) for x, y in zip(of[:rows], of[rows:]))
            else:
                out.extend(np.array([H.ngram_jaccard(H.tokens_of(x), H.tokens_of(y), n) for n in orders]) for x, y in zip(*[s.to_pylist() for s in sides]))
        return _doubles(out, [len(orders)] * len(a))

    return jaccard


@F.arrow_udf(T.LongType())
def n_words_udf(s: pa.Array) -> pa.Array:
    """Number of whitespace tokens; ``str.split`` is the rule of ``text.tokens_ws``."""
    return pa.array([None if x is None else len(x.split()) for x in s.to_pylist()], pa.int64())


#: Pairs whose vectors and results are in a worker's memory at once.
PAIR_ROWS = 64


def sliced_udf(kind, of: Callable):
    """A column of ``kind`` from array columns, made by the Arrow function ``of`` from ``PAIR_ROWS`` rows at a time.

    What comes out of a slice goes back to Spark before the next is made, however many rows a batch has.
    """
    def slices(columns):
        for at in range(0, len(columns[0]), PAIR_ROWS):
            yield of(*[c.slice(at, PAIR_ROWS) for c in columns])

    @F.arrow_udf(kind)
    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from slices(columns)

    @F.arrow_udf(kind)
    def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield from slices((column,))

    # marked so that Spark makes the column once: it puts what is deterministic also into the filters that read it
    return lambda *columns: (run if len(columns) > 1 else run_one).asNondeterministic()(*columns)


def lcs_lens(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([H.lcs_len(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())


lcs_len_udf = sliced_udf(T.LongType(), lcs_lens)


_P1, _P2, _P3, _P4, _P5 = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return x ^ x >> np.uint64(32)


def smallest_hashes(lists: pa.Array, size: int) -> pa.Array:
    """The least ``xxhash64(x, i)`` of the 64-bit values x of each list, for the ints i from 1 to ``size``; none of an empty list."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
    with np.errstate(over="ignore"):
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        x = _turned(x * _P2, 31) * _P1 ^ (np.uint64(42) + _P5 + np.uint64(8))
        x = _spread(_turned(x, 27) * _P1 + _P4) + (_P5 + np.uint64(4))
        of = (np.arange(1, size + 1, dtype=np.uint64) * _P1)[:, None]
        least = [_spread(_turned(x[a:b] ^ of, 23) * _P2 + _P3).view(np.int64).min(axis=1) for a, b in zip(ends, ends[1:]) if a < b]
    high = np.where(np.diff(ends) > 0, size, 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(high))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *least])))


def looked_up(table) -> Callable:
    """Vectors and norms of the ids of rows, lists of id lists; ids at the same place in several lists go by their vector.

    ``table`` is a broadcast (ids, vectors, norms) in the order of the vectors; an id may have several.
    """
    held = []

    def look(groups: pa.Array) -> tuple[pa.Array, pa.Array]:
        ids, vectors, norms = table.value
        if not held:
            places = {}
            for at, i in enumerate(ids):
                places.setdefault(i, []).append(at)
            held.append(places)
        places = held[0]
        single = len(places) == len(ids)
        found, ends = [], [0]
        for lists in groups.to_pylist():
            if single and len(lists) == 1:
                found.extend(places[i][0] for i in lists[0] if i in places)
            else:
                found.extend(at for _, at in sorted((pos, at) for one in lists for pos, i in enumerate(one) for at in places.get(i, ())))
            ends.append(len(found))
        at, ends = pa.array(found, pa.int32()), pa.array(ends, pa.int32())
        return tuple(pa.ListArray.from_arrays(ends, x.take(at)) for x in (vectors, norms))

    return look


def vectors_udf(table):
    """``looked_up`` as a column."""
    look = looked_up(table)
    return sliced_udf("vec array<array<float>>, norm array<double>", lambda groups: pa.StructArray.from_arrays(look(groups), ["vec", "norm"]))


def _list_doubles(rows: list, high: list, wide: list) -> pa.Array:
    """Lists of vectors of doubles from matrices, ``high`` of them a row, each of its width in ``wide``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(high))), pa.int32()), _doubles([x.ravel() for x in rows], wide))


ALIGNED = _row(one=MATRIX, two=MATRIX)


def alignments(m: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Softmax of a score matrix by row over the second side's vectors, and by column over the first side's; none for a pair with an empty side."""
    def aligned(scores, vectors):
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e @ vectors / e.sum(axis=1, keepdims=True)

    sides = [], []
    for s, x, y in zip(_matrices(m), _matrices(a), _matrices(b)):
        whole = len(x) and len(y)
        sides[0].append(aligned(s, y) if whole else np.zeros((0, 0)))
        sides[1].append(aligned(s.T, x) if whole else np.zeros((0, 0)))
    return pa.StructArray.from_arrays([_list_doubles(rows, [len(r) for r in rows], [r.shape[1] for r in rows for _ in r]) for rows in sides], ["one", "two"])


CELL_SUMS = T.ArrayType(_row(mul=T.DoubleType(), plus=T.DoubleType(), minus=T.DoubleType(), concat=T.LongType()))


def cell_sums(a: pa.Array, b: pa.Array) -> pa.Array:
    """The sums of all element-wise cells (product, sum, difference) of two lists of vectors, and of their concatenations' lengths; none for a pair with an empty side."""
    out = []
    for x, y in zip(_matrices(a), _matrices(b)):
        if not (len(x) and len(y)):
            out.append([])
            continue
        x, y = x[:, None, :], y[None, :, :]
        out.append([{"mul": float((x * y).sum()), "plus": float((x + y).sum()), "minus": float((x - y).sum()), "concat": x.shape[0] * y.shape[1] * (x.shape[2] + y.shape[2])}])
    return pa.array(out, pa.list_(pa.struct([("mul", pa.float64()), ("plus", pa.float64()), ("minus", pa.float64()), ("concat", pa.int64())])))


SENTENCE = _row(mean=VECTOR, max=VECTOR, sum=VECTOR)


def sentences(vectors: pa.Array) -> pa.Array:
    """Element-wise mean, maximum and sum of a list of vectors; empty ones if it has none."""
    kinds, wide = ([], [], []), []
    for v in _matrices(vectors):
        for kind, of in zip(kinds, (np.mean, np.max, np.sum)):
            kind.append(of(v, axis=0) if len(v) else np.zeros(0))
        wide.append(len(kinds[0][-1]))
    return pa.StructArray.from_arrays([_doubles(kind, wide) for kind in kinds], ["mean", "max", "sum"])


def count_words(rows):
    """(word, n) from (t, w): how often each word of the texts ``t`` comes, a text counted ``w`` times.

    Each Arrow batch counts its own words, so that only a batch's distinct words are shuffled.  ``str.split``
    is the rule of ``text.tokens_ws``.
    """
    def count(batches):
        for batch in batches:
            found = Counter()
            for t, w in zip(batch["t"], batch["w"]):
                for word, n in Counter(t.split()).items():
                    found[word] += n * w
            if found:
                yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_ids_udf(lookup, last=None):
    """Places and ids of the known words in a token list, joined by blanks, with ``last`` so many at its end; ``lookup`` is a broadcast {word: [ids]}."""
    @F.pandas_udf("at array<int>, ids array<int>")
    def word_ids(joined: pd.Series) -> pd.DataFrame:
        known, at, ids = lookup.value, [], []
        for x in joined:
            found = [(pos, i) for pos, w in enumerate(H.tokens_of(x)) for i in known.get(w, ())]
            found = found if last is None else found[max(len(found) - last, 0):]
            at.append([pos for pos, _ in found])
            ids.append([i for _, i in found])
        return pd.DataFrame({"at": at, "ids": ids})

    return word_ids
