"""Nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced partitions with few edges between them; a
small classifier learns which partition a vector's neighbours are in; every vector is indexed in its
most probable partition, and a query visits the most probable ones until their probabilities add up.
Candidates are reranked by the exact inner product in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that the graph and the classifier are fitted on, at most.
SAMPLE = 8_192
NEIGHBOURS = 10
#: Partitions: one for about this many rows, within these bounds.
PARTITION_ROWS, LEAST, MOST = 2_000, 8, 256
#: A query visits partitions, most probable first, until their probabilities add up to this.
REACH = 0.95
#: Rows of one block of a partition; a block of vectors is compared with the queries that visit it.
BLOCK_ROWS = 4_096


@dataclass
class Index:
    """The classifier: two layers, from a unit vector to the log odds of the partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the vectors without null, zero and non-finite ones and rows without an id."""
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    v = F.col(embedding).cast("array<float>" if single else "array<double>")  # single precision is exact in doubles, and half the size
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Places of each sample vector's ``k`` largest inner products, block by block."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Partition of each node: near equal sizes, few edges between partitions.

    Starts with balanced halving along the widest direction, then moves nodes to the partition that most
    of their neighbours are in, where that has room; a node's gain decides who goes first.
    """
    own = np.zeros(len(x), np.int64)
    groups = [(np.arange(len(x)), parts)]
    label = 0
    rng = np.random.default_rng(seed)
    while groups:
        at, m = groups.pop()
        if m == 1:
            own[at] = label
            label += 1
            continue
        y = x[at] - x[at].mean(axis=0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(10):
            d = y.T @ (y @ d)
            d /= max(np.linalg.norm(d), 1e-30)
        order = at[np.argsort(y @ d, kind="stable")]
        cut = len(order) * (m // 2) // m
        groups += [(order[cut:], m - m // 2), (order[:cut], m // 2)]
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    a, b = np.concatenate((source, graph.ravel())), np.concatenate((graph.ravel(), source))
    room = int(np.ceil(len(x) / parts * slack))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (a, own[b]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), own]
        sizes, moved = np.bincount(own, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[own[i]] -= 1
                sizes[best[i]] += 1
                own[i], moved = best[i], moved + 1
        if not moved:
            break
    return own


def train(x: np.ndarray, target: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30, seed: int = 7) -> Index:
    """The classifier that gives each vector the shares of its neighbours' partitions, by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m1, m2, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at:at + 256]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - target[i]) / len(i)
            dh = (dz @ p[2].T) * (h > 0)
            grad, t = [x[i].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)], t + 1
            for w, g, a, b in zip(p, grad, m1, m2):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                w -= 0.003 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return Index(*p)


def fit(points: DataFrame, total: int, limit: int = SAMPLE) -> Index | None:
    """The index fitted on at most ``limit`` vectors, those whose id's hash is least; None without vectors."""
    key = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    share = min(1.0, 1.2 * limit / max(1, total))
    rows = points.filter(key < int(share * (1 << 30))).orderBy(key, "vec_id").limit(limit).toArrow()  # bounded
    if not len(rows):
        return None
    x = matrix(rows["v"])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = int(min(MOST, max(LEAST, total // PARTITION_ROWS), max(1, len(x) // 4)))
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1 or parts == 1:
        return Index(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    own = balanced_cut(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), own), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), k), own[graph].ravel()), 1.0)
    return train(x, target / target.sum(axis=1, keepdims=True), parts)


def routed(points: DataFrame, index: Index, reach: float) -> DataFrame:
    """(vec_id, v, parts): the partitions that a vector visits; with ``reach`` 0 the most probable alone."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = index.probabilities(matrix(batch.column(1)))
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
            visits = (before < reach).sum(axis=1).clip(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[:n] for o, n in zip(order.tolist(), visits)], pa.list_(pa.int32()))],
                                             ["vec_id", "v", "parts"])

    kind = points.schema["v"].dataType.simpleString()
    return points.mapInArrow(run, f"vec_id long, v {kind}, parts array<int>")


def _best(table: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest other vectors of a block for each of its visiting queries."""
    query = table["query"].to_numpy()
    ids, v = table["vec_id"].to_numpy(), matrix(table["v"])
    points = np.nonzero(~query)[0]
    points = points[np.argsort(ids[points], kind="stable")]  # ties go to the smaller id
    x, pid = v[points], ids[points]
    out = ([], [], [])
    asks = np.nonzero(query)[0]
    for at in range(0, len(asks) if len(points) else 0, 512):
        i = asks[at:at + 512]
        s = v[i] @ x.T
        s[ids[i][:, None] == pid[None, :]] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        for j, o, row in zip(i, order, s):
            o = o[np.isfinite(row[o])]
            out[0].append(np.full(len(o), ids[j]))
            out[1].append(pid[o])
            out[2].append(row[o])
    flat = [np.concatenate(c) if c else np.array([]) for c in out]
    return pa.table([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 20, reach: float = REACH, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``queries`` holds, its ``k`` nearest other rows.

    Nearness is the inner product of the original vectors in double precision, ties go to the smaller
    id.  Vectors that are null, zero, or hold null or non-finite components, and rows without an id,
    take no part; an id's repeated rows are one row (the first vector in order); vectors must be of one
    length; an empty table gives an empty result; other columns are not read.  Every row is indexed.  A
    partition's rows, and the queries that visit it, are split into blocks of bounded size; every block of
    queries meets every block of rows.
    """
    points = stored(usable(vectors, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    total = points.count()
    index = fit(points, total)
    if index is None:
        return points.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    parts = len(index.b2)
    placed = stored(routed(points, index, 0.0).select("vec_id", "v", F.get("parts", F.lit(0)).alias("part")), "placed")
    asked = stored(routed(points.filter(queries), index, reach).select("vec_id", "v", F.explode("parts").alias("part")), "asked")

    def blocks(rows):  # one row per partition reaches the driver
        sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        return F.get(F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // BLOCK_ROWS))) for i in range(parts)]), F.col("part"))

    rows, asks = blocks(placed), blocks(asked)
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = placed.select("part", dealt(rows).alias("block"), every(asks).alias("turn"), "vec_id", "v", F.lit(False).alias("query"))
    sought = asked.select("part", every(rows).alias("block"), dealt(asks).alias("turn"), "vec_id", "v", F.lit(True).alias("query"))
    both = held.union(sought)
    found = both.groupBy("part", "block", "turn").applyInArrow(lambda t: _best(t, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
