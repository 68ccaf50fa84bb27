"""Sampling, folds, dense ids and row/column stacking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(id_col, seed: int = 0) -> Column:
    """md5 of ``seed:id`` as hex: a deterministic, uniformly spread ordering key."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def kfold(df: DataFrame, id_col: str, n_splits: int = 5, seed: int = 123, out: str = "fold") -> DataFrame:
    """fold = first 32 bits of md5(seed:id) mod n (no shuffle, no ordering step)."""
    h = F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, (h % n_splits).cast("int"))


def rank_by_hash(df: DataFrame, id_col: str, seed: int = 0, prefix_chars: int = 4, out: str = "rank") -> DataFrame:
    """Exact 0-based rank of every row by (md5(seed:id), id) without a global window.

    Rows are bucketed by the hash prefix; a per-bucket count table (at most 16**prefix_chars rows,
    broadcast) gives each bucket's offset and rows are numbered inside their bucket only.
    """
    d = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, prefix_chars))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    d = d.join(F.broadcast(counts), "_b")
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)) - 1
    return d.withColumn(out, F.col("_before") + local).drop("_h", "_b", "_before")


def kfold_exact(df: DataFrame, id_col: str, n_splits: int = 5, seed: int = 123, out: str = "fold") -> DataFrame:
    """W2 ``exact=True``: equal-size folds over the md5 order (``ntile``: the first N mod k folds
    get one row more), from the distributed hash rank."""
    n = df.agg(F.count(F.lit(1))).scalar()
    q, rem = F.floor(n / n_splits), n % n_splits
    r = F.col("_rank")
    big = rem * (q + 1)
    fold = F.when(r < big, F.floor(r / (q + 1))).otherwise(rem + F.floor((r - big) / q))
    return rank_by_hash(df, id_col, seed, out="_rank").withColumn(out, fold.cast("int")).drop("_rank")


def first_by_hash(df: DataFrame, id_col: str, m, seed: int = 0, prefix_chars: int = 4) -> DataFrame:
    """Exactly the ``m`` rows with the smallest (md5(seed:id), id), without a global window.

    Rows are bucketed by the first ``prefix_chars`` hex digits of the hash (16**prefix_chars
    buckets).  A per-bucket count table (at most that many rows) gives the boundary bucket; rows
    below it are kept whole and only the boundary bucket is ranked.  ``m`` may be a Column
    (scalar subquery) or an int.
    """
    m = F.lit(m) if not isinstance(m, Column) else m
    d = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, prefix_chars))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    d = d.join(counts, "_b")
    whole = d.where(F.col("_before") + F.col("_n") <= m).withColumn("_r", F.lit(0))
    edge = d.where((F.col("_before") < m) & (F.col("_before") + F.col("_n") > m))
    edge = (edge.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)))
            .where(F.col("_before") + F.col("_r") <= m))
    inside = whole.unionByName(edge)
    return inside.drop("_h", "_b", "_n", "_before", "_r")


def balance(df: DataFrame, id_col: str, label: str, positive_rate: float, seed: int = 0) -> DataFrame:
    """Reach ``positive_rate`` by repeating the minority class.

    The class that is too frequent stays as it is; the other needs ``k`` times its rows, which is
    ``floor(k)`` full copies and ``floor(frac(k) * rows)`` further rows, the first by md5 rank.
    One-class, empty input or a target within 1e-6 of 0 or 1 returns the input unchanged.
    The class counts are one aggregate row; the copy count drives ``explode(sequence)``.
    """
    if positive_rate < 1e-6 or positive_rate > 1.0 - 1e-6:
        return df.withColumn("copy", F.lit(1))
    stats = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    pos, neg = stats["pos"], stats["neg"]
    if pos + neg == 0 or pos == 0 or neg == 0:
        return df.withColumn("copy", F.lit(1))
    few = 1 if pos < positive_rate * (pos + neg) else 0  # the class to repeat
    n_b, n_a = (pos, neg) if few else (neg, pos)
    share = positive_rate if few else 1.0 - positive_rate  # its share of the result
    k = n_a / n_b * share / (1.0 - share)
    full = math.floor(k + 1e-6)
    rest = k - full
    extra = int(math.floor(rest * n_b + 1e-9)) if rest > 1e-6 else 0
    a_label, b_label = 1 - few, few
    a = df.where(F.col(label) == a_label).withColumn("copy", F.lit(1))
    b = df.where(F.col(label) == b_label)
    out = a
    if full:
        out = out.unionByName(b.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(full)))))
    if extra:
        out = out.unionByName(first_by_hash(b, id_col, extra, seed).withColumn("copy", F.lit(full + 1)))
    return out


def dense_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Ids 0..n-1 in partition order (file/line order for a text scan).

    The per-partition row counts (one row per partition, a bound fixed by the partition count)
    give each partition's offset; no row leaves its partition.  The input plan must be
    deterministic, as it is scanned twice.
    """
    d = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off"))


def sample_rows(features: DataFrame, index: DataFrame, row_id: str = "row_id", ord_col: str = "ord") -> DataFrame:
    """Gather rows by an (ord, row_id) index table; order and repeats are kept (by ``ord``)."""
    return index.join(features, row_id, "inner")


def sample_cols(features: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Column subset (Catalyst prunes the rest down to the scan)."""
    return features.select(*keys, *cols)


def merge_rows(first: DataFrame, second: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Vertical stack; the second part's row ids continue after the first's."""
    offset = first.agg(F.coalesce(F.max(row_id) + 1, F.lit(0))).scalar()
    return first.unionByName(second.withColumn(row_id, F.col(row_id) + offset))


def merge_cols(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Horizontal stack by key; a key missing on either side is flagged (or raises if strict)."""
    l = left.withColumn("_l", F.lit(True))
    r = right.withColumn("_r", F.lit(True))
    out = l.join(r, keys, "full_outer")
    missing = F.col("_l").isNull() | F.col("_r").isNull()
    if strict:
        # a filter, not a column: a column that nobody reads would be pruned with its check
        stop = F.when(missing, F.raise_error(F.lit("rows without a partner")).cast("boolean")).otherwise(F.lit(True))
        return out.where(stop).drop("_l", "_r")
    return out.withColumn("row_missing", missing).drop("_l", "_r")


def shape(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, feature columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns) - len(keys)))
