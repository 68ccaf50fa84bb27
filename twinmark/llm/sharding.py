"""Sharding by a k-d tree over document metadata.

Each node of the tree is split at the byte-weighted median of its widest dimension until a leaf holds
the target bytes.  Only DataFrame expressions: the medians of all nodes of a level are found together by
narrowing an interval of keys through byte histograms, so no row moves while the tree is built, and a
dimension in which a third of all rows agree is split within that value by the rows' hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored

#: Buckets of each histogram pass.
BUCKETS = 4096
#: Ranges of the rows' tie-break hash and of hashed names.
TIES, NAMES = 1 << 50, 1 << 20
DIMENSIONS = ("source", "lang", "doc_id")


def metadata(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, d0, d1, d2, tie): the row's bytes plus one, whole-number dimensions, and a tie-break.

    Names become numbers by their hash; a null name or text is the empty one, a null id is 0 for the tree.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    name = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(NAMES))
    size = (F.octet_length(t) + 1).cast("long")
    tie = F.pmod(F.xxhash64(F.col(doc_id), F.xxhash64(t)), F.lit(TIES))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
                       name(source).alias("d0"), name(lang).alias("d1"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("d2"), tie.alias("tie"))


def _pick(values: list[int], node: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), node)


def _coordinate(dims: list[int], node: Column) -> Column:
    return F.get(F.array(*[F.col(f"d{i}") for i in range(len(DIMENSIONS))]), _pick(dims, node).cast("int"))


def _narrow(rows: DataFrame, key: Column, low: list[int], high: list[int], goal: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each node, the key at which the summed bytes pass its goal, the bytes below that key, and those at it.

    ``rows`` has ``node`` and ``size``; every pass cuts each node's interval [low, high] to one of
    ``BUCKETS`` parts by one small aggregate; it takes as many passes as the widest interval needs.
    """
    low, high, below, own, node = list(low), list(high), [0] * len(low), [0] * len(low), F.col("node")
    while any(a < b for a, b in zip(low, high)):
        width = [(b - a) // BUCKETS + 1 for a, b in zip(low, high)]
        inside = rows.withColumn("key", key).filter((F.col("key") >= _pick(low, node)) & (F.col("key") <= _pick(high, node)))
        bucket = F.floor((F.col("key") - _pick(low, node)) / _pick(width, node)).cast("long")
        found = inside.groupBy("node", bucket.alias("b")).agg(F.sum("size").alias("s")).collect()  # nodes x BUCKETS rows at most
        sums: dict[int, dict[int, int]] = {}
        for r in found:
            sums.setdefault(r.node, {})[r.b] = r.s
        for i in range(len(low)):
            taken, last = below[i], 0
            for b, s in sorted(sums.get(i, {}).items()):
                last, own[i] = b, s
                if taken + s > goal[i]:
                    break
                taken += s
            else:  # nothing reaches the goal: stay at the last bucket
                taken -= sums.get(i, {}).get(last, 0)
            below[i], low[i] = taken, low[i] + last * width[i]
            high[i] = min(high[i], low[i] + width[i] - 1)
    return low, below, own


def build(rows: DataFrame, leaves: int) -> DataFrame:
    """``rows`` (a stored table of ``metadata``) with ``node``: the leaf of the row, 0 to ``leaves`` - 1.

    A node of n leaves is split into floor(n / 2) and the rest at the matching share of its bytes, so any
    number of leaves gets near equal bytes: each split is off by half a row at most.  The widest dimension
    is the one whose range, as a share of the whole table's, is largest.  Each level reads the narrow
    table a few times and writes it once; only sums and ranges by node reach the driver.
    """
    k, node = len(DIMENSIONS), F.col("node")
    ranges = [F.min(f"d{i}").alias(f"low{i}") for i in range(k)] + [F.max(f"d{i}").alias(f"high{i}") for i in range(k)]
    rows, sizes, whole = rows.withColumn("node", F.lit(0)), [leaves], None
    while True:
        found = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()}
        if max(sizes) == 1 or not found:
            return rows
        span = lambda i, r: r[f"high{i}"] - r[f"low{i}"]
        whole = whole or [max(1, span(i, found[0])) for i in range(k)]
        dims, low, high, goal, first, following = [], [], [], [], [], []
        for i, n in enumerate(sizes):
            first.append(len(following))
            following += [n // 2, n - n // 2] if n > 1 else [1]
            r = found.get(i)
            d = max(range(k), key=lambda j: (span(j, r) / whole[j], -j)) if r else 0
            dims.append(d)
            low.append(r[f"low{d}"] if r else 0)
            high.append(r[f"high{d}"] if r and n > 1 else low[-1])
            goal.append(r["bytes"] * (n // 2) // n if r else 0)
        value, below, _ = _narrow(rows, _coordinate(dims, node), low, high, goal)
        at = _coordinate(dims, node)
        ties = [TIES - 1 if n > 1 else 0 for n in sizes]
        missing = [g - b for g, b in zip(goal, below)]
        tie, below, own = _narrow(rows.filter(at == _pick(value, node)), F.col("tie"), [0] * len(sizes), ties, missing)
        tie = [t + (2 * (g - b) > o) for t, g, b, o in zip(tie, missing, below, own)]  # the row at the median goes where it fits better
        right = (at > _pick(value, node)) | ((at == _pick(value, node)) & (F.col("tie") >= _pick(tie, node)))
        moved = _pick(first, node) + F.when((_pick([int(n > 1) for n in sizes], node) == 1) & right, 1).otherwise(0)
        rows, sizes = stored(rows.withColumn("node", moved.cast("int")), "tree"), following


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text",
          source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (gapless from 0 within the shard).

    The tree has ``shards`` leaves, or as many as ``target_bytes`` asks for.  Sizes of shards are near
    equal; a shard is empty only if there are fewer rows than shards.  Null texts have size 1; null ids,
    sources and languages count as 0 and empty names for the tree and are returned as they are; repeated
    rows each get a place; an empty table gives an empty result; other columns are not read.
    """
    meta = stored(metadata(docs, doc_id, text, source, lang), "metadata")
    if shards is None:
        shards = max(1, -(-(meta.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    rows = stored(build(meta, shards).withColumn("part", F.spark_partition_id()), "shards")
    return ranked(rows, "node", ["tie", "doc_id", "size"]).select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), F.col("rank").alias("slot"))
