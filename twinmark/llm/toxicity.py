"""Toxicity: a linear-chain conditional random field over a line's words.

Only documents are labelled, so tokens get theirs from them: in a toxic document, a word is labelled
toxic if it, or a prefix of it, is found in toxic documents almost alone.  The field learns from these
labels which words and prefixes mark a toxic span, and how spans go on.  Forward-backward marginals give
each word's probability; a document's score is calibrated on its largest marginal and on how many words
are likely toxic, and the offending offsets are the runs of such words.

The field is fitted on a bounded sample of labelled documents; every document is tagged, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Labelled documents that the field and its calibration are fitted on, at most.
SAMPLE_DOCS = 20_000
#: Words and prefixes that the field may use, at most.
FEATURES = 4_000
#: Of these, features that do not mark toxic words but come nearest to it.
OTHERS = 200
PREFIXES = (4, 5, 6)
#: A feature marks toxic words if it stands in this many toxic sample documents, and so few others.
SUPPORT, PRECISION = 5, 0.9
TAGGED = 0.5
WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself (in lower case) and its prefixes, each under a name of its own."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Field:
    """A fitted field: weights of the toxic state by feature, its bias, transitions, and the calibration.

    ``prefixes`` are the first letters of all features, so that most words are passed over quickly.
    """

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    calibration: tuple[float, float, float] = (0.0, 1.0, 0.0)
    prefixes: frozenset[str] = frozenset()
    plain: dict[int, float] = field(default_factory=dict)

    def emissions(self, found: list[str]) -> list[float]:
        get = self.weights.get
        return [self.bias + sum(get(f, 0.0) for f in features(w)) if w[:4] in self.prefixes else self.bias for w in found]

    def marginals(self, emitted: list[float]) -> list[float]:
        """P(word t is toxic) for one line, by forward-backward over the ratio of the two states."""
        a, b, c, d = (exp(x) for x in self.moves)  # clean-clean, clean-toxic, toxic-clean, toxic-toxic
        n, ahead, odds = len(emitted), [], 1.0
        for t, e in enumerate(emitted):  # odds: toxic to clean, of all ways to come here
            odds = (1.0 if t == 0 else (b + odds * d) / (a + odds * c)) * exp(min(max(e, -50.0), 50.0))
            odds = min(max(odds, 1e-30), 1e30)
            ahead.append(odds)
        out, back = [0.0] * n, 1.0
        for t in range(n - 1, -1, -1):  # back: toxic to clean, of all ways to go on
            total = ahead[t] * back
            out[t] = total / (1.0 + total)
            x = min(max(exp(min(max(emitted[t], -50.0), 50.0)) * back, 1e-30), 1e30)
            back = (c + d * x) / (a + b * x)
        return out

    def tag(self, text: str) -> tuple[float, int, list[tuple[int, int]]]:
        """The largest marginal, how many words are likely toxic, and their runs as character offsets."""
        most, count, spans, at = 0.0, 0, [], 0
        for line in text.split("\n"):
            found = WORDS.findall(line.lower())
            if found and self.prefixes.isdisjoint([w[:4] for w in found]):  # no feature: the length decides
                n = len(found)
                if n not in self.plain:
                    self.plain[n] = max(self.marginals([self.bias] * n))
                most = max(most, self.plain[n])
            elif found:
                p = self.marginals(self.emissions(found))
                most = max(most, max(p))
                likely = [x >= TAGGED for x in p]
                count += sum(likely)
                spans += self.runs(line, found, likely, at)
            at += len(line) + 1
        return most, count, spans

    @staticmethod
    def runs(line: str, found: list[str], likely: list[bool], at: int) -> list[tuple[int, int]]:
        """Character offsets, in the text as it is, of each run of likely words."""
        places = [m.span() for m in WORDS.finditer(line)]
        if len(places) != len(found):  # lower case split a word in two; its offsets are the line's
            return [(at, at + len(line))] if any(likely) else []
        out: list[list[int]] = []
        for i, yes in enumerate(likely):
            if yes and out and i and likely[i - 1]:
                out[-1][1] = at + places[i][1]
            elif yes:
                out.append([at + places[i][0], at + places[i][1]])
        return [(a, b) for a, b in out]

    def score(self, most: float, count: int) -> float:
        z = np.dot(self.calibration, inputs(most, count))
        return float(1.0 / (1.0 + exp(-min(max(z, -40.0), 40.0))))


def inputs(most: float, count: int) -> tuple[float, float, float]:
    p = min(max(most, 1e-6), 1 - 1e-6)
    return 1.0, log(p / (1 - p)), log1p(count)


def sample(docs: DataFrame, labels: DataFrame, learnable: Column, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic): at most ``limit`` labelled documents, those whose id's hash is least.

    The ids are chosen before any text is read; as there are at most ``limit`` of them, they may be sent
    to every task, and no text is shuffled.
    """
    usable = labels.filter(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, 1.2 * limit / max(1, usable.count()))  # thins the rows that are sorted; the hash is uniform
    ids = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(limit)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(ids), "doc_id")
    return stored(known.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")), "labelled")


def distinct_lines(known: DataFrame) -> DataFrame:
    """(text, toxic): each different line of the sample once, toxic if it stands in toxic documents alone.

    Copies of a document so count once, and their rare words do not pass for toxic ones.
    """
    lines = known.select(F.explode(F.split("text", "\n")).alias("text"), "toxic")
    return stored(lines.filter("text != ''").groupBy("text").agg(F.min("toxic").alias("toxic")), "lines")


def _counts(lines: DataFrame) -> dict[str, tuple[int, int]]:
    """Toxic and clean lines that hold each feature, for features of enough toxic ones."""
    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {f for w in set(WORDS.findall(text.lower())) for f in features(w)}
                (toxic if label else clean).update(own)
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()),
                                          pa.array([clean[f] for f in names], pa.int64())], ["f", "t", "c"])

    total = lines.mapInArrow(run, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = total.filter(F.col("t") >= SUPPORT).orderBy((F.col("t") / (F.col("t") + F.col("c"))).desc(), F.col("t").desc(), "f").limit(FEATURES)
    return {r.f: (r.t, r.c) for r in best.collect()}


def _lines(lines: DataFrame, weights: dict[str, int], marks: frozenset[str]) -> list:
    """The sample's lines with features, as (places, features, labels, words), and the others' lengths."""
    heads = frozenset(f.lstrip("=")[:4] for f in weights)

    def run(batches):
        rows, plain = [], Counter()
        for batch in batches:
            for line, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = WORDS.findall(line.lower())
                at, which, toxic = [], [], []
                for i, w in enumerate(found):
                    if w[:4] in heads:
                        own = [f for f in features(w) if f in weights]
                        at += [i] * len(own)
                        which += [weights[f] for f in own]
                        if label and any(f in marks for f in own):
                            toxic.append(i)
                if at:
                    rows.append((len(found), 1, at, which, toxic))
                elif found:
                    plain[len(found)] += 1
        rows += [(n, c, [], [], []) for n, c in plain.items()]
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), ints, ints, ints))],
                                         ["n", "c", "at", "which", "toxic"])

    return lines.mapInArrow(run, "n int, c long, at array<int>, which array<int>, toxic array<int>").collect()


def fit_chain(lines: list, size: int, steps: int = 40, decay: float = 1e-4, width: int = 64) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions that maximise the labels' likelihood, by Adam on the exact gradient.

    Lines are cut at ``width`` words for fitting only; lines of equal length without features count once.
    """
    plain = Counter()
    rows: list[tuple[int, int, list, list, set]] = []
    for n, c, at, which, toxic in lines:
        for start in range(0, n, width):
            m = min(width, n - start)
            own = [(i - start, f) for i, f in zip(at, which) if start <= i < start + m]
            if own:
                rows.append((m, c, [i for i, _ in own], [f for _, f in own], {i - start for i in toxic if start <= i < start + m}))
            else:
                plain[m] += c
    rows += [(n, c, [], [], set()) for n, c in plain.items()]
    if not rows:
        return np.zeros(size), -6.0, np.zeros((2, 2))
    high = max(r[0] for r in rows)
    length, count = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    at, which = np.array([i for r in rows for i in r[2]], int), np.array([f for r in rows for f in r[3]], int)
    gold = np.zeros((len(rows), high), int)
    for i, r in enumerate(rows):
        gold[i, list(r[4])] = 1
    inside = np.arange(high) < length[:, None]
    follows = inside[:, 1:]
    seen = np.array([[(count[:, None] * (follows & (gold[:, :-1] == i) & (gold[:, 1:] == j))).sum() for j in (0, 1)] for i in (0, 1)])
    total = count.sum()
    theta = np.zeros(size + 5)
    theta[size] = -4.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, moves = theta[:size], theta[size], theta[size + 1:].reshape(2, 2)
        e = np.full((len(rows), high), bias)
        np.add.at(e, (row, at), w[which])
        state = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.zeros_like(state), np.zeros_like(state)
        alpha[:, 0] = state[:, 0]
        for t in range(1, high):
            new = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + state[:, t]
            alpha[:, t] = np.where(inside[:, t, None], new, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(high - 2, -1, -1):
            go = state[:, t + 1] + beta[:, t + 1]
            new = np.stack([np.logaddexp(moves[i, 0] + go[:, 0], moves[i, 1] + go[:, 1]) for i in (0, 1)], axis=1)
            beta[:, t] = np.where(inside[:, t + 1, None], new, 0.0)
        p = np.where(inside, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0.0)
        miss = (p - gold) * count[:, None] * inside
        grad = np.zeros_like(theta)
        np.add.at(grad, which, miss[row, at])
        grad[size] = miss.sum()
        for i in (0, 1):
            for j in (0, 1):
                both = np.exp(np.clip(alpha[:, :-1, i] + moves[i, j] + state[:, 1:, j] + beta[:, 1:, j] - z[:, None], -700, 0))
                grad[size + 1 + 2 * i + j] = (both * follows * count[:, None]).sum() - seen[i, j]
        grad = grad / total + decay * theta * (np.arange(len(theta)) != size)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad ** 2
        theta = theta - 0.3 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return theta[:size], float(theta[size]), theta[size + 1:].reshape(2, 2)


def calibrate(rows: np.ndarray, label: np.ndarray, count: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; too little to learn from gives the prior."""
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        h = (rows * (count * p * (1 - p))[:, None]).T @ rows + np.eye(3) * 0.1
        step = np.linalg.solve(h, rows.T @ (count * (label - p)) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
    return tuple(float(x) for x in w)


def fit(known: DataFrame) -> Field:
    """The field fitted on ``known`` (text, toxic);
    an empty sample gives a field that calls nothing toxic."""
    lines = distinct_lines(known)
    counts = _counts(lines)
    marks = frozenset(f for f, (t, c) in counts.items() if t >= PRECISION * (t + c))
    others = sorted((f for f in counts if f not in marks), key=lambda f: (counts[f][1] / counts[f][0], f))[:OTHERS]
    names = {f: i for i, f in enumerate([*sorted(marks), *others])}
    weights, bias, moves = fit_chain(_lines(lines, names, marks), len(names))
    model = Field({f: float(weights[i]) for f, i in names.items()}, bias, tuple(float(x) for x in moves.ravel()),
                  prefixes=frozenset(f.lstrip("=")[:4] for f in names))

    def run(batches):
        for batch in batches:
            tags = [model.tag(t)[:2] for t in batch.column(0).to_pylist()]
            rows = Counter((round(inputs(m, 0)[1], 3), c, int(label)) for (m, c), label in zip(tags, batch.column(1).to_pylist()))
            keys = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.float64()), pa.array([k[1] for k in keys], pa.int64()),
                                              pa.array([k[2] for k in keys], pa.int32()), pa.array([rows[k] for k in keys], pa.int64())],
                                             ["x", "c", "label", "n"])

    tagged = known.mapInArrow(run, "x double, c long, label int, n long").collect()  # the bounded sample
    if tagged:
        x = np.array([[1.0, r.x, log1p(r.c)] for r in tagged])
        model.calibration = calibrate(x, np.array([r.label for r in tagged], float), np.array([r.n for r in tagged], float))
    return model


def score(docs: DataFrame, model: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, n_toxic_words, spans (array of start, end in characters).

    Null and empty texts have no spans and the score of a text without words; a null id is kept; repeated
    rows each get a row; an empty table gives an empty result; only the two named columns are read.
    """
    def run(batches):
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            tags = [model.tag(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.score(m, c) for m, c, _ in tags], pa.float64()), pa.array([c for _, c, _ in tags], pa.int64()),
                 pa.array([[{"start": a, "end": b} for a, b in s] for _, _, s in tags], spans)], ["doc_id", "score", "n_toxic_words", "spans"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, n_toxic_words long, spans array<struct<start:int,end:int>>")


def drop_toxic(docs: DataFrame, model: Field, threshold: float, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; columns and texts as they were."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches):
            kept = [model.score(*model.tag(t or "")[:2]) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
