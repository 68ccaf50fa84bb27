"""Best-fit packing with large-item matching.

Sizes are whole numbers up to the capacity, so the packing of any number of pieces is planned on their
histogram, whose length is the capacity.  Pieces of one size are alike; each finds its place by its rank
among them, and ranks come from counts by size and partition.  Nothing else reaches the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, slices, stored

CAPACITY = 2048


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: itself if it fits, else full pieces behind a first one of what is left."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part[, ids]): every document's ids with ``end`` behind them, cut.

    ``part`` numbers the task that made the row.  ``ids`` are little-endian unsigned 32-bit integers.
    """
    last = end.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        from .tokens import byte_tokens

        vocabulary = byte_tokens(path)
        for batch in slices(batches):
            out = [[] for _ in names]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, start = vocabulary.encode(t or "") + last, 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    own = ids[start * 4:(start + n) * 4]
                    for column, v in zip(out, (doc, k, start, n, zlib.crc32(own), own)):
                        column.append(v)
                    start += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, bins, items per bin, first bin, offset), and the number of bins.

    Pieces above a third of the capacity go two to a bin at most: from the largest down, each takes the
    largest partner that fits.  Smaller pieces, from the largest down, fill the tightest gap that holds
    them; as equal pieces would follow into the same bin, a gap takes as many of them as fit.  Equal
    bins are handled together, so the work depends on the capacity, not on the number of pieces.
    """
    left, rank = dict(histogram), dict.fromkeys(histogram, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    runs, opened = [], 0

    def free(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if not gaps.setdefault(gap, []):
                insort(order, gap)
            gaps[gap].append((first, bins))

    def put(size: int, bins: int, each: int, first: int, offset: int) -> None:
        runs.append((size, rank[size], bins, each, first, offset))
        rank[size] += bins * each
        left[size] -= bins * each

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            partner = next((s for s in large if s <= min(size, capacity - size) and left[s] > (s == size)), None)
            if partner == size:
                bins = left[size] // 2
                put(size, bins, 2, opened, 0)
            else:
                bins = min(left[size], left[partner]) if partner else left[size]
                put(size, bins, 1, opened, 0)
                if partner:
                    put(partner, bins, 1, opened, size)
            free(capacity - size - (partner or 0), opened, bins)
            opened += bins
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                bins = left[size] // each or 1
                free(capacity, opened, bins)
                opened += bins
                continue
            gap = order[at]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            each = min(gap // size, left[size])
            used = min(bins, left[size] // each)
            put(size, used, each, first, capacity - gap)
            free(gap - each * size, first, used)
            free(gap, first + used, bins - used)
    return runs, opened




def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (a stored table with doc_id, piece, length, part) with sequence_id and offset."""
    spark = rows.sparkSession
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    runs, _ = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for size, *run in runs:
        by_length.setdefault(size, []).append(tuple(run))
    kinds = "length long, runs array<struct<first:long,bins:long,each:long,sequence:long,offset:long>>"
    planned = spark.createDataFrame(list(by_length.items()), kinds)  # bounded by the capacity, so it may be broadcast
    numbered = ranked(rows, "length", [c for c in rows.columns if c not in ("length", "part")])
    hit = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["bins"] * r["each"]))
    found = numbered.join(F.broadcast(planned), "length").withColumn("r", F.get(hit, F.lit(0))).withColumn("j", F.col("rank") - F.col("r.first"))
    return found.withColumn("sequence_id", F.col("r.sequence") + F.col("j") % F.col("r.bins")) \
        .withColumn("offset", (F.col("r.offset") + F.floor(F.col("j") / F.col("r.bins")) * F.col("length")).cast("long")) \
        .select(*[c for c in rows.columns if c != "part"], "sequence_id", "offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Null and empty texts are one piece that holds ``end`` alone; documents beyond the capacity are cut,
    others stay whole; a null id is kept; repeated rows are packed each; an empty table gives an empty
    result; other columns are not read.  With ``with_ids`` the rows carry their ids.
    """
    return place(stored(pieces(docs, path, capacity, end, with_ids, doc_id, text), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from ``pack(..., with_ids=True)``.

    A group holds one sequence, so at most the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    whole = F.aggregate(F.transform("p", lambda x: F.hex(x["ids"])), F.lit(""), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length")).select("sequence_id", "length", F.unhex(whole).alias("ids"))
