"""Language-model scoring with a Brown class-based bigram.

P(word | history) = P(class | class before) * P(word | class).  Exchange clustering finds the classes:
each word seen more than once in training moves to the class that raises the likelihood of all class
bigrams most.  The most frequent words and the groups of endings are dealt first, exactly, on the driver;
then sweeps over the stored counts of neighbouring words move all words, given only the table of classes
by classes.  Words seen once or never have their ending's class.  Counts cover every training document.
The most frequent words' counts and classes go to every task, a fixed number of them; those of all other
words are joined, so the vocabulary may be of any size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: Frequent words whose counts every task holds; of these, words that the driver deals before the sweeps.
HEAD, SINGLE = 50_000, 700
#: Groups of rarer words, by the hash of the last bytes, and that number of bytes.
ENDINGS, ENDING = 128, 2
CLASSES, SWEEPS = 64, 12
#: Words of this count or more have a class of their own choice; sweeps over all of them, at most.
LEAST, WORD_SWEEPS = 2, 2
#: Words of the sweeps, beside the head, whose classes every task looks up; the others' are joined.
WIDE = 400_000
#: Pairs of neighbouring words that a task sorts at once, and pieces of the most frequent word's lists.
PAIRS, PIECES = 2_000_000, 256
#: Neighbours whose lists a task makes at once, but for a word that has more.
ENTRIES = 200_000
#: Words that a task scores at once.
TOKENS = 500_000
#: Distinct words that a task counts or remembers at once.
CACHE = 400_000
SEED = 42


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case: on bytes, only A-Z change and only ASCII white space splits."""
    return (text or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text as bytes); tasks count ahead, in bounded memory."""
    def run(batches):
        def flush(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) >= CACHE:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def step() -> Column:
    """Step of a count ``c`` on a scale of 1,024 steps."""
    return F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")


def bar(counts: DataFrame, limit: int) -> int | None:
    """The lowest step so that at most ``limit`` rows are on it or above; None if that holds for no step."""
    bars = sorted(((r.b, r.n) for r in counts.groupBy(step().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = None, 0
    for b, n in bars:
        if held + n > limit:
            break
        least, held = b, held + n
    return least


def frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """At most ``limit`` words, the most frequent first: all above a count that a histogram of counts gives."""
    least = bar(counts, limit)
    if least is None:
        return []
    rows = counts.filter(step() >= least).toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


def word_id(word: bytes) -> int:
    """Key of a word outside the head: negative, from its 64-bit hash; the lowest bits are its ending's group."""
    import xxhash

    key = (xxhash.xxh64_intdigest(word, SEED) << 7 | zlib.crc32(word[-ENDING:]) % ENDINGS) & (1 << 63) - 1
    return key - (1 << 63)


def id_column(word: Column) -> Column:
    """``word_id`` as an expression."""
    group = F.crc32(F.substring(word, -ENDING, ENDING)) % ENDINGS  # bytes, as in Codes
    return F.shiftleft(F.xxhash64(word), 7).bitwiseOR(group).bitwiseOR(F.lit(-(1 << 63)))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The values as binary cells; a cell starts at each place in ``first``."""
    offsets = np.append(first, len(values)).astype(np.int32) * np.int32(values[:1].nbytes or 1)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _entries(cells: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary cells, one behind the other, and how many each cell holds."""
    if not len(cells):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(kind), np.diff(offsets).astype(np.int64) // size


@dataclass
class Known:
    """The words that tasks know by a code: places in the head, the end, the endings' groups, then ``ids`` in order.

    ``ids`` are the most frequent words outside the head, at most ``WIDE``.  If they are ``whole``, no other
    word has a class of its own choice, and tasks read all others as their endings' groups at once.
    """

    head: int
    ids: np.ndarray
    whole: bool

    @property
    def first(self) -> int:
        return self.head + 1 + ENDINGS

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes of ids; unknown words have their group's."""
        out, far = ids.copy(), np.flatnonzero(ids < 0)
        found = ids[far]
        out[far] = self.head + 1 + (found & ENDINGS - 1)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
            hit = self.ids[at] == found
            out[far[hit]] = self.first + at[hit]
        return out

    def kept(self, rows: DataFrame, known: bool) -> DataFrame:
        """The rows (id, k) whose id is one of ``ids``, or is not; decided in tasks."""
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array((self.codes(batch.column(0).to_numpy()) >= self.first) == known))

        return rows.mapInArrow(run, rows.schema)

    def by_code(self, head: np.ndarray, endings: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.concatenate((head, endings, rest)).astype(np.int16)

    def values(self, table: np.ndarray, w: np.ndarray) -> np.ndarray:
        """``table`` at codes; words that are still ids have their group's value."""
        return table[np.where(w >= 0, w, self.head + 1 + (w & ENDINGS - 1))]


class Places(dict):
    """Number of a word within a task: its place in the head, or one behind the end's."""

    def __init__(self, head: list[bytes], words: Known):
        super().__init__((w, i) for i, w in enumerate(head))
        self.words, self.first, self.rare = words, len(head) + 1, []
        self.ids = self.codes = np.arange(len(head) + 1)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = self.first + len(self.rare)
        self.rare.append(word_id(word))
        return place

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code of each number; only new words are looked up."""
        new = np.array(self.rare[len(self.ids) - self.first:], np.int64)
        self.ids = np.concatenate((self.ids, new))
        self.codes = np.concatenate((self.codes, self.words.codes(new)))
        return self.ids, self.codes


def known_words(counts: DataFrame, head: int) -> tuple[Known, DataFrame]:
    """The ``WIDE`` most frequent words of ``counts`` (h, c), as many as a histogram of counts allows, and the ids (nb) of the others."""
    moving = counts.filter(F.col("c") >= LEAST)
    least = bar(moving, WIDE)
    ids = np.unique(moving.filter(F.lit(False) if least is None else step() >= least).select("h").toArrow()["h"].to_numpy())
    words = Known(head, ids, moving.count() == len(ids))
    return words, words.kept(moving.select(F.col("h").alias("nb"), F.lit(0).alias("k")), False).select("nb")


def word_lists(texts: DataFrame, head: list[bytes], words: Known) -> DataFrame:
    """(w, ones, more, far), stored by word: the words to the right (side 0) and left (1) of each word.

    ``w`` is a word's code, or its id if tasks do not know it; a document starts behind the end of another.
    ``ones`` holds side * 2^31 + code of neighbours seen once by a task, ``more`` n * 2^32 + that of the
    others; ``far`` names, with side * 2^32 + n, the neighbours that tasks do not know, which are counted with
    their groups too.
    A word beside itself is listed on the right alone.  A task lists each word once for every ``PAIRS``
    pairs; the rows of a word are brought together, those of the i-th most frequent in ``1 + PIECES / i``
    pieces: its share of all words is 1 / i at most, so no piece holds more than one in ``PIECES``.
    ``merged`` then makes one row of a word's neighbouring rows.
    """
    names = ["w", "ones", "more", "far"]

    def run(batches):
        def flush(places, parts):
            ids, code = places.named()
            own = code if words.whole else np.where((ids < 0) & (code < words.first), ids, code)
            own, at = np.unique(own, return_inverse=True)
            tokens = at.astype(np.int32)[np.concatenate(parts)]
            parts.clear()
            code = words.values(np.arange(words.first + len(words.ids)), own)
            keys = tokens[:-1].astype(np.int64)
            keys <<= 32
            keys |= tokens[1:]
            keys.sort()
            new = np.flatnonzero(np.diff(keys, prepend=-1) != 0)  # the first of equal pairs
            n = np.diff(new, append=len(keys)).astype(np.int32)
            keys = keys[new]
            right, left = (keys >> 32).astype(np.int32), (keys & (1 << 32) - 1).astype(np.int32)
            del keys, tokens, at, new
            back = np.flatnonzero(right != left).astype(np.int32)
            back = back[np.argsort(left[back], kind="stable")]
            all_words = np.arange(len(own) + 1)
            to, fro = np.searchsorted(right, all_words), np.searchsorted(left[back], all_words)
            cuts = np.searchsorted(to + fro, np.arange(0, len(right) + len(back), ENTRIES))
            cuts = np.unique(np.append(cuts, len(own)))
            for first, last in zip(np.append(0, cuts), cuts):  # the lists of some words at a time
                yield from lists(first, last, own, code, right, left, n, slice(to[first], to[last]), back[fro[first]:fro[last]])

        def lists(first, last, own, code, right, left, n, r, b):
            w = np.concatenate((right[r], left[b])) - first
            order = np.argsort(w, kind="stable")
            w = w[order]
            nb = np.concatenate((left[r], right[b]))[order]
            side = np.repeat(np.array((0, 1), np.int64), (r.stop - r.start, len(b)))[order]
            n = np.concatenate((n[r], n[b]))[order].astype(np.int64)
            at = np.arange(last - first)
            entry, once = side << 31 | code[nb], n == 1
            ones = _lists(entry[once].astype(np.uint32), np.searchsorted(w[once], at))
            more = _lists((n << 32 | entry)[~once], np.searchsorted(w[~once], at))
            far = own[nb] < 0
            named = np.column_stack((own[nb[far]], side[far] << 32 | n[far]))
            cells = [pa.array(own[first:last]), ones, more, _lists(named, np.searchsorted(w[far], at))]
            yield from slices([pa.RecordBatch.from_arrays(cells, names)], 20_000)

        end = np.array([len(head)], np.int32)
        places, parts, held = Places(head, words), [end], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = words_of(text)
                parts += [np.fromiter(map(places.__getitem__, found), np.int32, len(found)), end]
                held += len(found) + 1
                if held >= PAIRS or len(places.rare) >= CACHE:
                    yield from flush(places, parts)
                    if len(places.rare) >= CACHE:
                        places = Places(head, words)
                    parts, held = [end], 0
        if held:
            yield from flush(places, parts)

    w = F.col("w")
    common = F.when(w == len(head), 0).when(w < len(head), w).otherwise(w - len(head) - 1) + 1  # the end and the endings as the most frequent
    pieces = F.when((w >= 0) & (w < words.first), F.floor(PIECES / common) + 1).otherwise(1)
    rows = texts.mapInArrow(run, "w long, ones binary, more binary, far binary").filter("length(ones) > 0 or length(more) > 0")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("ones", "more"), pieces)).repartition("w", "piece")
    return stored(merged(rows.drop("piece").sortWithinPartitions("w"), words), "lists")


def _runs(w: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    return np.flatnonzero(np.append(np.full(len(w[:1]), True), w[1:] != w[:-1]))


def merged(lists: DataFrame, words: Known) -> DataFrame:
    """``word_lists``'s rows, sorted by word: one row of those of a word that follow each other in a batch.

    A word that tasks do not know and that is seen less than ``LEAST`` times never moves, so only the words to
    its right count, as its ending's group's: such words go into the rows of their groups.  All rows of such a
    word are in one task; the first and the last word of a batch may go on in the next and stay as they are.
    """
    names = ["w", "ones", "more", "far"]

    def run(batches):
        few, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(0).to_numpy()
            first = _runs(w)
            cells, right = [], np.zeros(len(first))
            for i, kind in ((1, np.uint32), (2, np.int64), (3, np.int64)):
                v, size = _entries(batch.column(i), kind)
                ends = np.append(0, np.cumsum(size))
                at = np.append(ends[first], ends[-1])
                cells.append((v, at))
                if i < 3:
                    n = ((v >> 31 & 1) == 0) * (v >> 32 if i == 2 else 1)
                    right += np.diff(np.append(0, np.cumsum(n))[at])
            w = w[first]
            rare = (w < 0) & (right < LEAST)
            rare[[0, -1]] = False
            if rare.any():
                group = words.head + 1 + (w & ENDINGS - 1)
                few.append(_right(cells, np.flatnonzero(rare), group))
                held += sum(len(v) for _, v in few[-1])
            rows = pa.RecordBatch.from_arrays([pa.array(w), *[_lists(v, at[:-1]) for v, at in cells]], names)
            yield rows.filter(pa.array(~rare)) if rare.any() else rows
            if held >= ENTRIES:
                yield from groups(few)
                few, held = [], 0
        if few:
            yield from groups(few)

    def groups(few):
        of = [(np.concatenate([g for g, _ in x]), np.concatenate([v for _, v in x])) for x in zip(*few)]
        w = np.unique(np.concatenate([g for g, _ in of]))
        cells = []
        for g, v in of:
            order = np.argsort(g, kind="stable")
            cells.append(_lists(v[order], np.searchsorted(g[order], w)))
        yield pa.RecordBatch.from_arrays([pa.array(w), *cells], names)

    return lists.mapInArrow(run, lists.schema)


def _right(cells: list, chosen: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Group and value of each entry to the right in the ``chosen`` rows, for each column of ``cells`` (values, bounds)."""
    out = []
    for i, (v, at) in enumerate(cells):
        step = 1 + (i == 2)  # a neighbour that tasks do not know has two values
        v = v.reshape(-1, step)
        low, size = at[chosen] // step, (at[chosen + 1] - at[chosen]) // step
        place = np.repeat(low - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
        g, found = np.repeat(group[chosen], size), v[place]
        left = (found[:, 0] >> 31 if i == 0 else found[:, 0] >> 31 & 1 if i == 1 else found[:, 1] >> 32) != 0
        out.append((np.repeat(g[~left], step), found[~left].ravel()))
    return out


def far_neighbours(lists: DataFrame) -> DataFrame:
    """(w, side, nb, n): the neighbours that tasks do not know, a row each."""
    def run(batches):
        for batch in slices(batches, 20_000):
            v, size = _entries(batch.column(1), np.int64)
            w, (nb, n) = np.repeat(batch.column(0).to_numpy(), size // 2), v.reshape(-1, 2).T
            side = (n >> 32).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(side), pa.array(nb.copy()), pa.array(n & (1 << 32) - 1)], ["w", "side", "nb", "n"])

    return lists.filter("length(far) > 0").select("w", "far").mapInArrow(run, "w long, side int, nb long, n long")


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, side, code and count of each entry of a batch of (w, ones, more)."""
    (one, a), (more, b) = _entries(batch.column(1), np.uint32), _entries(batch.column(2), np.int64)
    rows = np.arange(batch.num_rows)
    entry = np.concatenate((one.astype(np.int64), more & (1 << 32) - 1))
    n = np.concatenate((np.ones(len(one), np.int64), more >> 32))
    return np.concatenate((np.repeat(rows, a), np.repeat(rows, b))), entry >> 31, entry & (1 << 31) - 1, n


def unit_bigrams(lists: DataFrame, words: Known, head: list[bytes], single: int) -> np.ndarray:
    """Counts of neighbouring units: the ``single`` most frequent words, the endings' groups, and the end."""
    size = single + ENDINGS + 1
    unit = words.by_code(np.append(code_units(head, single)[:len(head)], size - 1), single + np.arange(ENDINGS), single + (words.ids & ENDINGS - 1))

    def run(batches):
        table = np.zeros(size * size, np.int64)
        for batch in slices(batches, 4096):
            row, side, code, n = _listed(batch)
            right = side == 0
            own = words.values(unit, batch.column(0).to_numpy()).astype(np.int64)
            cells, at = np.unique(own[row[right]] * size + unit[code[right]], return_inverse=True)
            table[cells] += np.bincount(at, n[right], len(cells)).astype(np.int64)
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], ["cell", "n"])

    each = lists.select("w", "ones", "more").mapInArrow(run, "cell long, n long")
    rows = each.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    out = np.zeros(size * size)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def code_units(head: list[bytes], single: int) -> np.ndarray:
    """Unit of each code; a frequent word that is not clustered by itself belongs to its ending's group."""
    own = [i if i < single else single + zlib.crc32(w[-ENDING:]) % ENDINGS for i, w in enumerate(head)]
    return np.array(own + list(range(single, single + ENDINGS + 1)), np.int64)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit (the last unit, the end, keeps class 0 for itself), by exchange clustering.

    Starts with the units dealt round by frequency.  A unit moves if that raises the sum of
    N(k, l) log N(k, l) less the marginals' terms; sweeps stop when none moves.
    """
    size = len(n)
    free = max(1, min(classes - 1, size - 1))
    order = np.argsort(-(n.sum(0) + n.sum(1))[:-1], kind="stable")
    own = np.zeros(size, np.int64)
    own[order] = 1 + np.arange(size - 1) % free
    k = free + 1
    table = np.zeros((k, k))
    np.add.at(table, (own[:, None], own[None, :]), n)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a = own[u]
            r, q, s = np.bincount(own, n[u], k), np.bincount(own, n[:, u], k), n[u, u]
            r[a] -= s
            q[a] -= s
            table[a] -= r
            table[:, a] -= q
            table[a, a] -= s
            wide, tall, diag = table + r[None, :], table + q[:, None], np.diag(table)
            gain = (_f(wide) - _f(table)).sum(1) + (_f(tall) - _f(table)).sum(0)
            gain += _f(diag + r + q + s) - _f(diag) - (_f(diag + r) - _f(diag)) - (_f(diag + q) - _f(diag))
            left, right = table.sum(1), table.sum(0)
            gain -= _f(left + r.sum() + s) - _f(left) + _f(right + q.sum() + s) - _f(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            own[u], moved = b, moved + (b != a)
            table[b] += r
            table[:, b] += q
            table[b, b] += s
        if not moved:
            break
    return own


@dataclass
class Classes:
    """Class of every training word: arrays for the head (and the end) and the endings; a stored table (id, k) for the rest.

    The table holds the words of ``LEAST`` or more outside the head; all others have their ending's class.
    """

    head: np.ndarray  # of each word of the head, then of the end
    endings: np.ndarray
    rest: DataFrame


#: Added to a class that is a word's own, where its row has its ending's class.
OWN = 1 << 16


def neighbours(lists: DataFrame, classes: Classes, words: Known, others: DataFrame | None, size: int, left: bool = True) -> DataFrame:
    """(w, k, own, e): each word with its class, whether it may move, and its neighbours' classes, stored.

    ``e`` lists n * 65536 + side * size + class, as bytes: n neighbours of a class on the right (0) or left (1),
    and n times itself (side 2, class 0).  Tasks look the classes up; where a word's is in the table alone, it
    comes as a row of its own, and the entries of its neighbours (``others``) are put right.  All rows of a word
    are brought together and merged.  Without ``left`` only neighbours on the right are listed, all that the
    counts of neighbouring classes need.
    """
    rest = words.kept(classes.rest.select("id", "k"), True).toArrow()  # at most WIDE rows
    wide = np.zeros(len(words.ids), np.int64)
    wide[np.searchsorted(words.ids, rest["id"].to_numpy())] = rest["k"].to_numpy()
    table = words.by_code(classes.head, classes.endings, wide)

    def run(batches):
        for batch in slices(batches, 4096):
            row, side, code, n = _listed(batch)
            if not left:
                row, side, code, n = (x[side == 0] for x in (row, side, code, n))
            w = batch.column(0).to_numpy()
            cell = np.where(code == w[row], 2 * size, side * size + table[code])
            names, at = np.unique(w, return_inverse=True)
            counts = np.bincount(at[row] * (3 * size) + cell, n, len(names) * 3 * size).astype(np.int64)
            cells = np.flatnonzero(counts)
            offsets = np.searchsorted(cells, np.arange(len(names) + 1) * (3 * size)).astype(np.int32)
            e = _lists(counts[cells] << 16 | cells % (3 * size), offsets[:-1])
            own = (names >= 0) & ((names <= words.head) | (names >= words.first))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(words.values(table, names).astype(np.int32)), pa.array(own), e], ["w", "k", "own", "e"])

    def corrected(batches):
        for batch in batches:
            w, side, k, was, n = (batch.column(i).to_numpy() for i in range(5))
            now = np.where(batch.column(5).to_numpy(zero_copy_only=False), 2 * size, side * size + k)
            order = np.argsort(w, kind="stable")
            first = _runs(w[order])
            e = np.column_stack((-n << 16 | side * size + was, n << 16 | now))[order].ravel()
            none = np.full(len(first), -1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w[order][first]), pa.array(none), pa.array(none > 0), _lists(e, 2 * first)], ["w", "k", "own", "e"])

    def together(batches):
        def rows(w, k, own, v, at, first):
            k = np.maximum.reduceat(k, first)
            own = np.maximum.reduceat(own, first) | (k >= OWN)
            return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(k % OWN), pa.array(own), _lists(v, at[first])], ["w", "k", "own", "e"])

        held = None  # the last word, whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            w, k, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v, n = _entries(batch.column(3), np.int64)
            if held is not None:
                w, k, own, v, n = (np.concatenate(x) for x in zip(held, (w, k, own, v, n)))
            first, at = _runs(w), np.append(0, np.cumsum(n))
            last = first[-1]
            if last:
                yield rows(w[:last], k[:last], own[:last], v[:at[last]], at, first[:-1])
            counts = np.bincount(v[at[last]:] & 65535, v[at[last]:] >> 16, 3 * size).astype(np.int64)
            cells = np.flatnonzero(counts)
            held = w[-1:], k[last:].max(keepdims=True), own[last:].max(keepdims=True), counts[cells] << 16 | cells, np.array([len(cells)])
        if held is not None:
            yield rows(*held[:4], np.zeros(1, np.int64), np.zeros(1, np.int64))

    schema = "w long, k int, own boolean, e binary"
    near = lists.select("w", "ones", "more").mapInArrow(run, schema)
    if others is not None:
        start = F.get(F.array(*[F.lit(int(k)) for k in classes.endings]), F.col("nb").bitwiseAND(F.lit(ENDINGS - 1)).cast("int"))
        both = others.filter("true" if left else "side = 0").join(classes.rest.select(F.col("id").alias("nb"), "k"), "nb").withColumn("was", start).filter("k != was or nb = w")
        put = both.select("w", *[F.col(c).cast("long") for c in ("side", "k", "was", "n")], (F.col("nb") == F.col("w")).alias("itself"))
        near = near.unionByName(put.mapInArrow(corrected, schema))
        joined = words.kept(classes.rest.select("id", "k"), False)
        near = near.unionByName(joined.select(F.col("id").alias("w"), (F.col("k") + OWN).cast("int").alias("k"), F.lit(True).alias("own"), F.lit(b"").alias("e")))
    return stored(near.repartition("w").sortWithinPartitions("w").mapInArrow(together, schema), "neighbours")


def _cells(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Own class, and the neighbours' counts by row, side and class, of a batch of (..., k, e)."""
    (v, n), rows = _entries(batch.column(batch.num_columns - 1), np.int64), batch.num_rows
    counts = np.bincount(np.repeat(np.arange(rows), n) * (3 * size) + (v & 65535), v >> 16, rows * 3 * size)
    return batch.column(batch.num_columns - 2).to_numpy(), counts.reshape(rows, 3, size)


def class_bigrams(near: DataFrame, size: int) -> np.ndarray:
    """Counts of neighbouring classes."""
    def run(batches):
        table = np.zeros((size, size))
        for batch in slices(batches):
            k, counts = _cells(batch, size)
            np.add.at(table, k, counts[:, 0])
            np.add.at(table, (k, k), counts[:, 2, 0])
        k, l = np.nonzero(table)  # noqa: E741
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(l), pa.array(table[k, l])], ["k", "l", "n"])

    rows = near.select("k", "e").mapInArrow(run, "k long, l long, n double").groupBy("k", "l").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((size, size))  # at most size * size rows
    for r in rows:
        table[r.k, r.l] = r.n
    return table


def likelihood(table: np.ndarray) -> float:
    """What exchange raises: the log likelihood of all class bigrams, up to a constant."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def gains(right: np.ndarray, left: np.ndarray, twice: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gain in likelihood of moving each word alone to each class; 0 for its own.

    ``right`` and ``left`` count a word's neighbours by class, without itself; ``twice`` counts itself
    beside itself.  Rows and columns of the old and the new class change; the four cells where they cross
    are put right afterwards.
    """
    at, k = np.arange(len(own)), len(table)
    out, gone = np.zeros((len(own), k)), np.zeros(len(own))
    for near, t in ((right, table), (left, table.T)):
        w, l = np.nonzero(near)  # noqa: E741
        n, cells = near[w, l], t.T[l]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        if len(w):
            out[w[first]] += np.add.reduceat(_f(cells + n[:, None]) - _f(t).T[l], first, axis=0)
            cell = t[own[w], l]
            gone += np.bincount(w, _f(cell - n) - _f(cell), len(own))
        total, side = near.sum(1) + twice, t.sum(1)
        out -= _f(side + total[:, None]) - _f(side)
        gone -= _f(side[own] - total) - _f(side[own])
    out += gone[:, None]
    r_a, q_a, s = right[at, own][:, None], left[at, own][:, None], twice[:, None]
    aa, ab, ba, bb = table[own, own][:, None], table[own], table.T[own], np.diag(table)[None, :]
    out += _f(aa - r_a - q_a - s) - _f(aa - r_a) - _f(aa - q_a) + _f(aa)
    out += _f(bb + right + left + s) - _f(bb + right) - _f(bb + left) + _f(bb)
    out += _f(ab - right + q_a) - _f(ab - right) - _f(ab + q_a) + _f(table)[own]
    out += _f(ba + r_a - left) - _f(ba + r_a) - _f(ba - left) + _f(table).T[own]
    out[at, own] = 0
    return out


def moved(near: DataFrame, words: Known, table: np.ndarray) -> DataFrame:
    """(id, k): the best class of every word of the head and of the classes' table; the end keeps class 0 for itself."""
    size = len(table)

    def run(batches):
        for batch in slices(batches):
            own, counts = _cells(batch, size)
            gain = gains(counts[:, 0], counts[:, 1], counts[:, 2, 0], own, table)
            gain[:, 0] = -np.inf
            best = gain.argmax(1)
            best = np.where(gain[np.arange(len(own)), best] > 1e-6, best, own).astype(np.int32)
            ids = batch.column(0).to_numpy().copy()
            wide = ids >= words.first
            ids[wide] = words.ids[ids[wide] - words.first]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], ["id", "k"])

    return near.filter("own and k != 0").select("w", "k", "e").mapInArrow(run, "id long, k int")


def sweep(lists: DataFrame, classes: Classes, words: Known, beyond: DataFrame, k: int, sweeps: int) -> tuple[Classes, np.ndarray]:
    """Classes after at most ``sweeps`` sweeps over all words, and their table; stops when the likelihood no longer rises."""
    others = None if words.whole else stored(far_neighbours(lists).join(beyond, "nb"), "others")
    near = neighbours(lists, classes, words, others, k)
    table = class_bigrams(near, k)
    for i in range(sweeps):
        rows = stored(moved(near, words, table), "classes")
        head = classes.head.copy()
        top = rows.filter("id >= 0").toArrow()  # the head
        head[top["id"].to_numpy()] = top["k"].to_numpy()
        new = Classes(head, classes.endings, rows.filter("id < 0"))
        discard(near)
        near = neighbours(lists, new, words, others, k, left=i < sweeps - 1)
        new_table = class_bigrams(near, k)
        if likelihood(new_table) <= likelihood(table):
            break
        classes, table = new, new_table
    discard(near, *([] if others is None else [others]))
    return classes, table


@dataclass
class Model:
    """What scoring needs in every task, and the joined rest: counts of all words as a stored table.

    ``classes`` are those of the head, the endings' groups and the end; ``counted`` and ``grouped`` hold
    count and class by the codes of ``words``, where the endings' groups stand for words that are joined.
    """

    head: list[bytes]
    words: Known
    classes: np.ndarray
    counted: np.ndarray
    grouped: np.ndarray
    moves: np.ndarray  # log10 P(class | class before)
    inside: np.ndarray  # log10 of the denominator of P(word | class)
    total: int
    kinds: int
    counts: DataFrame  # (h, c, k): id, count and class of the words outside the head

    @property
    def base(self) -> float:
        """log10 of the base model's denominator."""
        return float(np.log10(self.total + 0.5 * (self.kinds + 1)))


def fit(docs: DataFrame, learnable: Column, text: str = "text", head_words: int = HEAD, single: int | None = None, classes: int = CLASSES,
        sweeps: int = WORD_SWEEPS) -> Model:
    """Counts, classes and probabilities from the rows of ``docs`` for which ``learnable`` holds.

    Within a class, words have c + 0.5 and all unseen words together 0.5, over the class's total;
    transitions are smoothed by the classes' own frequencies.  Without training rows every count is 0.
    ``single`` limits clustering to so many frequent words; all others then have their ending's class.
    """
    texts = docs.filter(learnable).select(F.col(text).cast("binary").alias("text"))
    counts = stored(word_counts(texts), "words")
    ends = texts.count()
    top = frequent(counts, head_words)
    head, c = [w for w, _ in top], np.array([n for _, n in top], float)
    dealt = min(SINGLE if single is None else single, len(head))
    held = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"word": pa.array(head, pa.binary())})))
    tail = stored(counts.join(held, "word", "left_anti").select(id_column(F.col("word")).alias("h"), "c"), "tail")
    words, beyond = known_words(tail, len(head))
    lists = word_lists(texts, head, words)
    discard(counts)
    bigrams = unit_bigrams(lists, words, head, dealt)
    own = exchange(bigrams, classes)
    k = int(own.max()) + 1
    table = np.zeros((k, k))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)
    of_code = own[code_units(head, dealt)]
    endings = of_code[len(head):-1]
    start = F.get(F.array(*[F.lit(int(x)) for x in endings]), F.col("h").bitwiseAND(F.lit(ENDINGS - 1)).cast("int"))
    rest = tail.withColumn("k", start)
    if single is None and ends:
        moving = rest.filter(F.col("c") >= LEAST).select(F.col("h").alias("id"), "k")
        first = Classes(np.append(of_code[:len(head)], of_code[-1]), endings, moving)
        last, table = sweep(lists, first, words, beyond, k, sweeps)
        of_code[:len(head)] = last.head[:-1]
        found = last.rest.select(F.col("id").alias("h"), F.col("k").alias("_k"))
        chosen = rest.filter(F.col("c") >= LEAST).join(found, "h", "left").select("h", "c", F.coalesce("_k", "k").alias("k"))
        rest = stored(chosen.unionByName(rest.filter(F.col("c") < LEAST)), "rest")
        discard(tail)
    discard(lists)
    n_class, v_class = np.bincount(of_code[:len(head)], c, k), np.bincount(of_code[:len(head)], minlength=k).astype(float)
    for r in rest.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row for each class
        n_class[r.k], v_class[r.k] = n_class[r.k] + r.n, v_class[r.k] + r.v
    n_class[0], v_class[0] = n_class[0] + ends, v_class[0] + int(ends > 0)
    overall = (table.sum(0) + 0.5) / (table.sum() + 0.5 * k)
    moves = (table + k * overall) / (table.sum(1, keepdims=True) + k)
    wide = words.kept(rest, True).toArrow()  # at most WIDE rows
    at = np.searchsorted(words.ids, wide["h"].to_numpy())
    wide_k, wide_c = np.zeros(len(words.ids), np.int64), np.zeros(len(words.ids))
    wide_k[at], wide_c[at] = wide["k"].to_numpy(), wide["c"].to_numpy()
    grouped = words.by_code(np.append(of_code[:len(head)], of_code[-1]), endings, wide_k)
    counted = np.concatenate((c, [ends], np.zeros(ENDINGS), wide_c))
    return Model(head, words, of_code, counted, grouped, np.log10(moves), np.log10(n_class + 0.5 * (v_class + 1)), int(n_class.sum()),
                 int(v_class.sum()), rest)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    A task adds up what it knows of a document and lists its rarer words, by id, with their places; their
    counts and classes are joined by that id, and go back to the row.  Null and empty texts are their end
    alone; a null id is kept; repeated rows each get a row; an empty table gives an empty result; other
    columns are not read.
    """
    head, words, classes, counted, moves, inside = model.head, model.words, model.grouped, model.counted, model.moves, model.inside
    logc, base, total, end = np.log10(counted + 0.5), model.base, model.total, len(model.head)

    def run(batches):
        def flush(places, ids, parts, sizes):
            own, code = places.named()
            tokens, start = np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))
            c = code[tokens]
            k, far = classes[c].astype(np.int64), (c > end) & (c < words.first)
            before = np.concatenate(([classes[end]], k[:-1]))  # a document starts behind an end
            far_before = np.concatenate(([False], far[:-1]))
            add = lambda x: pa.array(np.add.reduceat(x, start[:-1]))
            weight = np.where(far, 0, logc[c])
            gain = np.where(far, 0, weight - inside[k]) + np.where(far | far_before, 0, moves[before, k])
            places_far = np.flatnonzero(far)
            doc = np.searchsorted(start, places_far, "right") - 1
            rare, at = np.unique(doc * len(own) + tokens[places_far], return_inverse=True)
            first = np.searchsorted(rare, np.arange(len(sizes) + 1) * len(own))
            near = np.searchsorted(places_far, start)
            ints = lambda x: pa.ListArray.from_arrays(pa.array(near.astype(np.int32)), pa.array(x.astype(np.int32)))
            h = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own[rare % len(own)]))
            cells = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), add((counted[c] > 0).astype(np.int64)),
                     pa.array(np.add.reduceat(weight, start[:-1]) - np.array(sizes) * base), add(gain), h, ints(at - first[doc]),
                     ints(np.where(far_before[places_far], -1, before[places_far])), ints(np.where(far[places_far + 1], -1, k[places_far + 1]))]
            yield from slices([pa.RecordBatch.from_arrays(cells, names)])

        places, ids, parts, sizes, held = Places(head, words), [], [], [], 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text)
                parts += [np.fromiter(map(places.__getitem__, found), np.int64, len(found)), [end]]
                ids.append(doc)
                sizes.append(len(found) + 1)
                held += len(found) + 1
                if held >= TOKENS or len(places.rare) >= CACHE:
                    yield from flush(places, ids, parts, sizes)
                    if len(places.rare) >= CACHE:
                        places = Places(head, words)
                    ids, parts, sizes, held = [], [], [], 0
        if held:
            yield from flush(places, ids, parts, sizes)

    def finish(batches):
        for batch in slices(batches):
            col = {n: batch.column(i) for i, n in enumerate([*names, "found"])}
            h, of_h, rows = col["h"].flatten().to_numpy(), col["h"].value_parent_indices().to_numpy(), batch.num_rows
            start = np.concatenate(([0], np.cumsum(np.bincount(of_h, minlength=rows))))
            k, c = classes[end + 1 + (h & ENDINGS - 1)].astype(np.int64), np.zeros(len(h))  # unseen words: 0.5 in their ending's class
            j, n, own = (x.to_numpy() for x in col["found"].flatten().flatten())
            j = j + start[col["found"].value_parent_indices().to_numpy()]
            c[j], k[j] = n, own
            row = col["at"].value_parent_indices().to_numpy()
            at = col["at"].flatten().to_numpy() + start[row]
            before, after = (col[x].flatten().to_numpy() for x in ("before", "after"))
            here, weight = k[at], np.log10(c + 0.5)
            before = np.where(before < 0, np.roll(here, 1), before)
            gain = moves[before, here] + np.where(after < 0, 0, moves[here, after]) + (weight - inside[k])[at]
            add = lambda name, x: pa.array(col[name].to_numpy() + np.bincount(row, x, rows))
            known_too = col["n_known"].to_numpy() + np.bincount(row, c[at] > 0, rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([col["doc_id"], col["n_tokens"], pa.array(known_too), pa.array(np.full(rows, total)),
                                              add("base_score", weight[at]), add("score", gain)], final)

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "h", "at", "before", "after"]
    final = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, h array<long>, at array<int>, before array<int>, after array<int>"
    rows = stored(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.posexplode("h").alias("j", "h"))
    found = rare.join(model.counts, "h").groupBy("row").agg(F.collect_list(F.struct("j", "c", "k")).alias("found"))
    none = F.array().cast("array<struct<j:int,c:bigint,k:int>>")
    whole = rows.join(found, "row", "left").select(*names, F.coalesce("found", none).alias("found"))
    return whole.mapInArrow(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
