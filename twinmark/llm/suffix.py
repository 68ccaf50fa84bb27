"""Suffix-array dedup with longest-previous-factor arrays, over all documents together.

A byte is repeated if a string of ``LENGTH`` bytes that covers it starts elsewhere too.  Sorting every suffix
of a corpus is out of reach, so suffixes first meet by what they hold: of the ``GRAM``-byte strings in each
window of ``LENGTH`` bytes, the one of least hash is the window's anchor.  Equal windows have equal anchors
at equal places, and the windows of one anchor follow one another, so a row for each anchor (about one in
85 bytes) stands for all windows.

1. Anchors are sorted by gram and content over all tasks.  Neighbours of equal content are copies of each
   other as a whole; grams met once are done; what is left are grams around which contents differ in part.
2. For these, suffix order: the contents that share a gram are concatenated in the order of their places, and
   their suffixes are sorted by their first ``LENGTH`` bytes, by prefix doubling, ties by place.  A suffix has a
   previous factor of that length if the previous smaller place in suffix order agrees on ``LENGTH`` bytes,
   and as ties are in the order of places, that is the suffix just before it.  In the same way, the suffix
   just behind it is a later copy.

Groups that are cut by the edge of a task, or too large for it, are done piece by piece; one row for each
content or window of a piece is then counted by Spark's aggregates and joined, so a passage may stand in any
share of all documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

LENGTH, GRAM = 200, 32
SEED = 42
#: Windows of a text that are hashed at once.
BLOCK = 1 << 20
#: Rows of one gram that a task holds at most, and contents of one gram that it compares at once (some 2 MB).
HELD_ROWS, HELD_CONTENTS = 200_000, 4_096
#: Bytes whose suffixes are sorted at once.
SORTED_BYTES = 2 << 20
PLACE = ["id", "h", "n"]
_LAST = (1 << 63) - 1
_CARRY = np.uint64


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, int]:
    """A random odd number for each byte, and the multiplier of the rolling hash."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, 256, dtype=_CARRY) * _CARRY(2) + _CARRY(1), int(rng.integers(1 << 61, 1 << 62)) * 2 + 1


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each place on, by doubling."""
    letter, by = _letters()
    out, width = letter[text], 1
    while width < GRAM:
        out = out[:-width] * _CARRY(by) + out[width:]
        by, width = by * by % (1 << 64), 2 * width
    out ^= out >> _CARRY(29)
    return out * _CARRY(0xBF58476D1CE4E5B9)


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the anchor, its hash) of each anchor of a text of ``length`` bytes or more.

    The anchor of a window is the first gram of least hash in it.
    """
    hashes = gram_hashes(text)
    span = length - GRAM + 1
    key = (hashes & ~_CARRY((1 << 24) - 1)) | np.arange(len(hashes), dtype=_CARRY)
    blocks = np.concatenate((key, np.full(-len(key) % span, ~_CARRY(0)))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(key) - span + 1
    least = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
    place = (least & _CARRY((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.diff(first, append=windows), place[first], hashes[place[first]].view(np.int64)


ANCHOR = "g long, c long, id long, h long, n int, lo int, w int, off int"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(g, c, id, h, n, lo, w, off): for each anchor its gram, the hash of its content, its document, and its windows.

    Windows start at ``lo`` to ``lo + w - 1``; the content is their bytes; the anchor is ``off`` bytes behind ``lo``.
    """
    def run(batches):
        import xxhash

        content = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            parts, c = [], []
            for i, t in enumerate(batch.column(3).to_pylist()):
                text = np.frombuffer(t, np.uint8)
                for at in range(0, len(t) - length + 1, BLOCK):  # the windows of a long text, block by block
                    lo, w, place, g = anchors(text[at:at + BLOCK + length - 1], length)
                    lo, off = lo + at, place - lo
                    c += [content(t[a:b], o) for a, b, o in zip(lo.tolist(), (lo + w - 1 + length).tolist(), off.tolist())]
                    parts.append(np.stack((np.full(len(lo), i), lo, w, off, g)))
            if parts:
                i, lo, w, off, g = np.concatenate(parts, axis=1)
                doc = batch.select([0, 1, 2]).take(pa.array(i))  # without the texts
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.array(c, np.uint64).view(np.int64)), doc.column(0), doc.column(1), doc.column(2),
                                                  *[pa.array(x.astype(np.int32)) for x in (lo, w, off)]], [x.split()[0] for x in ANCHOR.split(", ")])

    return docs.select(*PLACE, "text").mapInArrow(run, ANCHOR)


def whole_groups(batches, key: str, weight, most: float, least: int, edges: bool):
    """Pieces of rows sorted by ``key``: (True, all rows of one or more keys) or (False, rows of a key that may go on elsewhere).

    With ``edges`` the first and the last key of a task may go on in another one, and a key of more than
    ``most`` (as ``weight`` counts rows) is not held; other keys are gathered up to ``least``.
    """
    rest, first, open_key = None, edges, None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        keys = rest.column(key).to_numpy()
        while len(keys) and (first or open_key is not None):
            if open_key is None:
                open_key, first = keys[0], False
            end = int(np.searchsorted(keys, open_key, side="right"))
            yield False, rest.slice(0, end)
            rest, keys = rest.slice(end), keys[end:]
            if len(keys):
                open_key = None
        if len(keys):
            last = int(np.searchsorted(keys, keys[-1]))
            if weight(rest.slice(0, last)) >= least:
                yield True, rest.slice(0, last)
                rest, keys = rest.slice(last), keys[last:]
                last = 0
            if weight(rest.slice(last)) > most:
                if last:
                    yield True, rest.slice(0, last)
                open_key = keys[-1]
                yield False, rest.slice(last)
                rest = None
        if rest is not None and not rest.num_rows:
            rest = None
    if rest is not None:
        keys = rest.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1])) if edges else rest.num_rows
        if last:
            yield True, rest.slice(0, last)
        if edges:
            yield False, rest.slice(last)


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of rows sorted by gram and content: the content each row belongs to, its first row, its rows, and whether its gram has others."""
    g, c = batch.column("g").to_numpy(), batch.column("c").to_numpy()
    new_g = np.diff(g, prepend=g[0]) != 0
    new = new_g | (np.diff(c, prepend=c[0]) != 0)
    new[0] = new_g[0] = True
    own = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    gram = np.cumsum(new_g[first]) - 1
    return own, first, np.bincount(own), np.bincount(gram)[gram] > 1


def copies(anchored: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans, contents): windows that are copies by their whole content, and contents that share a gram with different ones.

    spans: (id, h, n, lo, w, later); ``later`` where an earlier copy stands.  contents: one row for each, at
    its first place, with ``m``, its number of copies.
    """
    keys = ["g", "c", *PLACE, "lo"]
    placed = anchored.repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = [x.split()[0] for x in ANCHOR.split(", ")]

    def run(batches):
        def rows(kind, batch, m):
            n = batch.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *batch.columns, pa.array(m.astype(np.int64))], ["kind", *names, "m"])

        for whole, batch in whole_groups(batches, "g", lambda b: b.num_rows, HELD_ROWS, HELD_ROWS // 4, True):
            own, first, n, several = _runs(batch)
            copied = np.flatnonzero(n[own] > 1)
            origin = first[own[copied]]
            same = np.ones(len(copied), bool)  # rows equal in id and text are one place
            for x in (*PLACE, "lo"):
                v = batch.column(x).to_numpy()
                same &= v[copied] == v[origin]
            yield rows(0, batch.take(pa.array(copied)), ~same)
            some = several if whole else np.ones(len(first), bool)
            yield rows(1 if whole else 2, batch.take(pa.array(first[some])), n[some])

    found = stored(placed.mapInArrow(run, f"kind int, {ANCHOR}, m long"), "copies")
    spans = found.filter("kind = 0").select(*PLACE, "lo", "w", (F.col("m") > 0).alias("later"))
    contents = found.filter("kind = 1").select(*names, "m")
    edge = found.filter("kind = 2").select(*names, "m")  # a row for each content and task
    place = F.struct(*PLACE, "lo")
    counted = stored(edge.groupBy("g", "c").agg(F.sum("m").alias("m"), F.min(F.struct(place.alias("place"), "w", "off")).alias("first")), "edges")
    again = edge.join(counted.filter("m > 1").select("g", "c", F.col("first.place").alias("place")), ["g", "c"]).select(*PLACE, "lo", "w", (place != F.col("place")).alias("later"))
    several = counted.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g")
    more = counted.join(several, "g").select("g", "c", "first.place.id", "first.place.h", "first.place.n", "first.place.lo", "first.w", "first.off", "m")
    return spans.unionByName(again), contents.unionByName(more)


def prefix_ranks(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each of ``places`` on in byte order, equal ones alike, by prefix doubling."""
    value, width = text.astype(np.uint64), 1
    while width < min(8, length):
        step = min(width, length - width)
        value = value[:-step] << _CARRY(8 * step) | value[step:] & _CARRY((1 << 8 * step) - 1)
        width += step
    rank = np.unique(value, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        at = places if width + step == length else np.arange(len(rank) - step)
        rank = np.unique(rank[at] * len(rank) + rank[at + step], return_inverse=True)[1]
        width += step
        if width == length:
            return rank
    return rank[places]


def factors(text: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending ``places``: does an earlier, does a later one agree with it on ``length`` bytes?

    In suffix order with ties by place, the previous smaller place that agrees is the neighbour in front, and
    the next larger one the neighbour behind.
    """
    rank = prefix_ranks(text, places, length)
    order = np.argsort(rank, kind="stable")
    alike = rank[order[1:]] == rank[order[:-1]]
    previous, following = np.zeros(len(places), bool), np.zeros(len(places), bool)
    previous[order[1:]], following[order[:-1]] = alike, alike
    return previous, following


SPAN = "id long, h long, n int, lo int, w int, later boolean, x long, y long, m long"


def _spans(doc: pa.RecordBatch, row: np.ndarray, start: np.ndarray, flag: np.ndarray, later: bool) -> pa.RecordBatch:
    """Windows with a flag, as runs of windows that follow one another in a content."""
    at = np.flatnonzero(flag)
    cut = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(row[at], prepend=-1) != 0))
    n = np.diff(cut, append=len(at))
    own = doc.take(pa.array(row[at[cut]]))
    lo = own.column("lo").to_numpy() + start[at[cut]]
    none = pa.nulls(len(cut), pa.int64())
    return pa.RecordBatch.from_arrays([own.column("id"), own.column("h"), own.column("n"), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)),
                                       pa.array(np.full(len(cut), later)), none, none, none], [x.split()[0] for x in SPAN.split(", ")])


def partial_copies(docs: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """(id, h, n, lo, w, later): windows of ``contents`` that others of the same gram hold too."""
    def cut(batches):
        for batch in slices(batches):
            parts = batch.column(4)
            at = parts.value_parent_indices()
            s, split, lo, w, m = parts.flatten().flatten()
            texts = batch.column(3).to_pylist()
            body = [texts[i][a:a + n - 1 + length] for i, a, n in zip(at.to_pylist(), lo.to_pylist(), w.to_pylist())]
            own = batch.select([0, 1, 2]).take(at)
            yield pa.RecordBatch.from_arrays([s, split, *own.columns, lo, w, m, pa.array(body, pa.binary())], ["s", "split", *PLACE, "lo", "w", "m", "body"])

    many = contents.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / HELD_CONTENTS).alias("pieces")).filter("pieces > 1")
    dealt = contents.join(many, "g", "left").withColumn("salt", F.pmod(F.xxhash64(*PLACE, "lo"), F.coalesce("pieces", F.lit(1))))
    part = F.struct(F.xxhash64("g", "salt").alias("s"), F.col("pieces").isNotNull().alias("split"), "lo", "w", "m")
    needed = dealt.groupBy(*PLACE).agg(F.collect_list(part).alias("parts"))
    bodies = docs.join(needed, PLACE).select(*PLACE, "text", "parts").mapInArrow(cut, "s long, split boolean, id long, h long, n int, lo int, w int, m long, body binary")

    def run(batches):
        import xxhash

        size_of = lambda b: pc.sum(pc.binary_length(b.column("body"))).as_py() or 0
        for _, batch in whole_groups(slices(batches, 4_096), "s", size_of, float("inf"), SORTED_BYTES, False):
            doc = pa.RecordBatch.from_struct_array(batch.select([*PLACE, "lo"]).to_struct_array())
            order = pc.sort_indices(doc, sort_keys=[(x, "ascending") for x in (*PLACE, "lo")])
            batch = batch.take(order)
            doc = batch.select([*PLACE, "lo"])
            same = np.ones(batch.num_rows, bool)  # rows equal in id and text are one place
            for x in (*PLACE, "lo"):
                v = doc.column(x).to_numpy()
                same[1:] &= v[1:] == v[:-1]
            same[0] = False
            batch, doc = batch.filter(pa.array(~same)), doc.filter(pa.array(~same))
            size = pc.binary_length(batch.column("body")).to_numpy()
            text = np.frombuffer(b"".join(batch.column("body").to_pylist()), np.uint8)
            w = batch.column("w").to_numpy()
            row = np.repeat(np.arange(len(w)), w)
            start = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
            previous, following = factors(text, start + (np.cumsum(size) - size)[row], length)
            yield _spans(doc, row, start, previous, True)
            yield _spans(doc, row, start, previous | following, False)
            at = np.flatnonzero(~previous & batch.column("split").to_numpy(zero_copy_only=False)[row])
            if len(at):  # each window of a gram in several pieces once, to be counted by Spark over all tasks
                bodies, many = batch.column("body").to_pylist(), batch.column("m").to_numpy()
                digest = b"".join(xxhash.xxh3_128_digest(bodies[r][i:i + length]) for r, i in zip(row[at].tolist(), start[at].tolist()))
                xy, own, k = np.frombuffer(digest, "<i8").reshape(-1, 2), doc.take(pa.array(row[at])), len(at)
                lo = pa.array((own.column("lo").to_numpy() + start[at]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("h"), own.column("n"), lo, pa.array(np.ones(k, np.int32)), pa.array([False] * k), pa.array(xy[:, 0]),
                                                  pa.array(xy[:, 1]), pa.array(np.where(following[at], 2, many[row[at]]).astype(np.int64))], [x.split()[0] for x in SPAN.split(", ")])

    found = stored(bodies.repartition("s").sortWithinPartitions("s").mapInArrow(run, SPAN), "factors")
    spans = [*PLACE, "lo", "w", "later"]
    done = found.filter("x is null").select(*spans)
    far = found.filter("x is not null")
    place = F.struct(*PLACE, "lo")
    common = far.groupBy("x", "y").agg(F.sum("m").alias("m"), F.min(place).alias("first")).filter("m > 1").select("x", "y", "first")
    return done.unionByName(far.select(*PLACE, "lo", "w", "x", "y").join(common, ["x", "y"]).select(*PLACE, "lo", "w", (place != F.col("first")).alias("later")))


def dedup(docs: DataFrame, keep: str | None = "first", length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the other bytes).

    A byte goes if ``length`` bytes around it also start elsewhere: with ``keep`` "first" only where the other
    place is earlier (by id, then hash of the text, then place; a null id is last), with None wherever it is.
    Strings are judged on the input and never cross documents.  Null text is empty; texts shorter than
    ``length`` bytes keep all; rows equal in id and text are one document to "first", and repeat each other
    otherwise; every row gets its result; an empty table gives an empty result; other columns are not read.
    A document is known by its id and 64 bits of its text's hash with its length; contents of equal gram are
    compared by 64 bits more, windows counted by Spark by 128 bits.
    """
    if keep not in ("first", None):
        raise ValueError("keep is 'first' or None")
    if not GRAM < length <= BLOCK:
        raise ValueError(f"length is from {GRAM + 1} to {BLOCK}")
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"))
    keyed = base.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"), "text")
    long = keyed.filter(F.col("n") >= length)
    spans, contents = copies(anchor_rows(long, length), length)
    spans = spans.unionByName(partial_copies(long, stored(contents, "contents"), length))
    if keep == "first":
        spans = spans.filter("later")
    gone = spans.groupBy(*PLACE).agg(F.collect_list(F.struct("lo", "w")).alias("gone"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def cut(batches):
        for batch in slices(batches):
            out = []
            for doc, t, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                removed = runs = 0
                if found:
                    lo, end = np.array([x["lo"] for x in found]), np.array([x["lo"] + x["w"] - 1 + length for x in found])
                    step = np.bincount(lo, minlength=len(t) + 1) - np.bincount(end, minlength=len(t) + 1)
                    mark = np.cumsum(step[:-1]) > 0
                    removed, runs = int(mark.sum()), int((np.diff(mark, prepend=False) & mark).sum())
                    t, size = np.frombuffer(t, np.uint8)[~mark].tobytes(), len(t)
                out.append((doc, size if found else len(t), removed, runs, t))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(),) * 4 + (pa.binary(),))], names)

    rows = keyed.join(gone, PLACE, "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
