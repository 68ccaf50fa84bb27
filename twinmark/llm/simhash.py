"""SimHash near-duplicates linked by the generalised pigeonhole principle.

A fingerprint's 64 bits are split into parts.  For thresholds t_i >= -1 over m parts whose sum is
``distance - m + 1``, two fingerprints within ``distance`` bits must differ by at most t_i bits in some
part i; so it is enough to look for partners part by part.  Correlated bits are put into the same part
(the parts are then as independent, and as selective, as they can be), and the unequal thresholds are
chosen by dynamic programming on the candidate counts that each part would give.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored
from .graph import components

BITS = 64
#: Buckets up to this size are verified pair by pair inside one row; larger ones by common neighbours.
BUCKET = 32
SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The signed 64-bit fingerprint of one UTF-8 text (0 for null or wordless texts)."""
    import xxhash

    found = (text or b"").lower().split()  # on bytes: only A-Z change, only ASCII white space splits
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(found)) - 1:].tolist())
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for a text of any length
        block = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns (doc_id, bits): one row per input row, texts read whole, one batch in memory at a time."""
    def run(batches):
        for batch in slices(batches):
            bits = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], ["doc_id", "bits"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, bits long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 matrix of common ones, over all fingerprints (64 rows reach the driver)."""
    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()), pa.array(both.tolist(), pa.list_(pa.float64()))],
            ["bit", "n", "both"])

    parts = prints.select("bits").mapInArrow(run, "bit int, n long, both array<double>")
    cells = parts.select("bit", "n", F.posexplode("both").alias("other", "v"))
    rows = cells.groupBy("bit", "other").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r.bit, r.other] = r.v
    return (rows[0].n if rows else 0), both


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of near equal width; each grows by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        width = -(-len(left) // (m - k))
        part = [left.pop(int(np.argmax(phi[np.ix_(left, left)].sum(axis=1))))]
        while len(part) < width:
            part.append(left.pop(int(np.argmax(phi[np.ix_(left, part)].sum(axis=1)))))
        parts.append(sorted(part))
    return parts


def _mask(part: list[int]) -> int:
    return _signed(sum(1 << b for b in part))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least cost; ``costs[i][t + 1]`` is part i's cost at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(part) - 1):
                option = (cost + part[t + 1], [*chosen, t])
                if used + t not in following or option[0] < following[used + t][0]:
                    following[used + t] = option
        best = following
    return best[total]


def plan(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The (bits, threshold) of each part that is probed, for all fingerprints of ``prints``.

    Equal part values are counted exactly (pre-aggregated).  A bucket costs its pairs, or for a large one
    the values around its members, as ``links`` verifies it.  How much comes within t more bits is
    estimated from each bit's share of ones.
    """
    around = sum(comb(BITS, j) for j in range(distance - distance // 2 + 1))
    n, both = bit_statistics(prints)
    options = {m: correlated_parts(n, both, m) for m in range(2, distance + 3)}
    keys = [(m, i, _mask(part)) for m, parts in options.items() for i, part in enumerate(parts)]
    probe = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.lit(mask).alias("mask")) for m, i, mask in keys]))
    counts = (prints.select("bits", probe.alias("k")).groupBy("k.m", "k.i", F.col("bits").bitwiseAND(F.col("k.mask")).alias("v"))
              .agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("m", "i").agg(F.sum(F.least(F.col("c") * (F.col("c") - 1) / 2, F.col("c") * around)).alias("work")).collect())
    equal = {(r.m, r.i): r.work for r in counts}
    p = np.diag(both) / max(n, 1)
    odds = (2 * p * (1 - p)) / np.clip(1 - 2 * p * (1 - p), 1e-9, None)
    found = []
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            near, growth, cost = np.array([1.0] + [0.0] * distance), 0.0, [0.0]
            for b in part:  # elementary symmetric sums of the odds: pairs that differ in exactly t of the bits
                near[1:] += near[:-1] * odds[b]
            for t in range(distance + 1):
                growth += near[t]
                cost.append(n * sum(comb(len(part), j) for j in range(t + 1)) + equal.get((m, i), 0.0) * growth)
            costs.append(cost)
        cost, chosen = allocate(costs, distance - m + 1)
        found.append((cost, m, [(part, t) for part, t in zip(parts, chosen) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def _longs(values: list[int]):
    return F.from_json(F.lit(str(values)), T.ArrayType(T.LongType())) if len(values) > 200 else F.array(*[F.lit(v) for v in values])


def links(prints: DataFrame, distance: int, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Columns (a, b): node ids of fingerprints within ``distance`` bits, enough of them to join every group.

    ``prints`` holds each fingerprint once: (node, bits).  Rows that share a probed part value form a
    bucket.  Buckets up to ``BUCKET`` rows are verified pair by pair.  In a larger bucket, members are
    verified by the values they have in common within half the distance, which costs each member a fixed
    number of rows however large the bucket is; no bucket is cut.
    """
    probes = None
    for i, (part, t) in enumerate(parts):
        key = F.col("bits").bitwiseAND(F.lit(_mask(part))).bitwiseXOR(F.col("flip"))
        one = prints.select("node", "bits", F.explode(_longs(_flips(part, t))).alias("flip")).select(
            F.lit(i).alias("part"), key.alias("key"), "node", "bits")
        probes = one if probes is None else probes.union(one)
    sizes = probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(probes.join(sizes, ["part", "key"]), "buckets")

    entry = F.struct(F.col("bits"), F.col("node"))
    cold = members.filter(F.col("n") <= BUCKET).groupBy("part", "key").agg(F.collect_list(entry).alias("all"))
    one = cold.select("all", F.explode("all").alias("x"))
    near = F.filter("all", lambda y: (y["node"] > F.col("x.node")) & (F.bit_count(y["bits"].bitwiseXOR(F.col("x.bits"))) <= distance))
    paired = one.select(F.col("x.node").alias("a"), F.explode(near).alias("y")).select("a", F.col("y.node").alias("b"))

    # Two values are within the distance if, and only if, some value is within its larger half of one
    # and within its smaller half of the other.  Where the halves differ, `tight` marks the smaller one.
    wide, tight = distance - distance // 2, distance // 2
    hot = members.filter(F.col("n") > BUCKET).select("node", "bits").distinct()
    around = hot.select("node", F.explode(_longs(_flips(list(range(BITS)), wide))).alias("flip"), "bits").select(
        "node", F.col("bits").bitwiseXOR(F.col("flip")).alias("near"), (F.bit_count("flip") <= tight).alias("tight"))
    common = around.groupBy("near").agg(F.min(F.when(F.col("tight"), F.col("node"))).alias("a"), F.collect_list("node").alias("all"))
    shared = common.filter((F.size("all") > 1) & F.col("a").isNotNull()).select("a", F.explode("all").alias("b")).filter("a != b")
    return paired.union(shared).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns (doc_id, bits, component_id): one row per input row.

    ``component_id`` is the smallest document id that is reached over fingerprints at most ``distance``
    bits apart.  Null, empty and wordless texts have fingerprint 0 and are linked like any other; equal
    fingerprints are one node whatever their number; a row without an id belongs to the component of
    its fingerprint and never names it; repeated rows are kept; an empty table gives an empty result;
    columns other than the two named are not read.
    """
    rows = stored(fingerprints(docs, shingle, doc_id, text), "prints")
    nodes = stored(rows.groupBy("bits").agg(F.min("doc_id").alias("node")).dropna(), "nodes")
    labels = components(links(nodes, distance, plan(nodes, distance)), "a", "b")
    named = nodes.join(labels, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "bits", "left").select("doc_id", "bits", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id, then of the least text hash.

    Groups go by the texts, so rows with a repeated or null id follow their own text; a null id is the last
    choice; of rows equal in id and text one stays.  Null, empty and wordless texts are copies of each
    other; an empty table gives an empty result; other columns are passed on, whatever their names.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(row, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    groups = near_duplicates(keyed, shingle, distance, doc_id="key", text="text").select(F.col("doc_id").alias("key"), "component_id").distinct()
    own = keyed.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    best = own.join(groups, "key").groupBy("component_id").agg(F.min(F.struct("first", "key")).alias("best")).select("best.key", F.col("best.first.id").alias("id"))
    kept = keyed.select("row", "key", "id").join(best.select(F.col("key").alias("_key"), F.col("id").alias("_id")), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["key"]).select(*[F.col("row")[c].alias(c) for c in names])
