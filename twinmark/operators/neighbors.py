"""Previous row within a group, for any key, without a one-task-per-group window.

``lag(order) OVER (PARTITION BY group ORDER BY order)`` puts a whole group into one task; with a
group holding a third of all rows that task is the job.  Here rows are range-partitioned and sorted by
(group, order), which cuts a large group into as many partitions as it fills, whatever its keys look like:

1. ``lag`` inside each (partition, group), so a task sorts one partition's rows at most;
2. the last key of each (partition, group), a row or two for each partition, is handed on to the
   next partition that holds the group;
3. the first row of a partition's group takes that key.

Only the narrow (group, key) columns are shuffled; equal keys stay in one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def range_sorted(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions, stored, with ``part``: the partition's place in that order."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return cut_lineage(dealt.sortWithinPartitions(*keys)).withColumn("part", F.spark_partition_id())


def handed_on(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(part, group, carried): the last key of the group in the partitions before; a row for each partition and group."""
    last = rows.groupBy("part", group).agg(F.max(order).alias("_last"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("part", group, F.max("_last").over(before).alias("carried"))


def previous_in_group(df: DataFrame, group: str, order: str, out: str = "prev", partitions: int | None = None) -> DataFrame:
    """Return ``(group, order, out)`` where ``out`` is the previous ``order`` value in the group; null keys are left out."""
    rows = range_sorted(df.select(group, order).where(F.col(order).isNotNull()), [group, order], partitions)
    inner = rows.withColumn("_own", F.lag(order).over(Window.partitionBy("part", group).orderBy(order)))
    carry = handed_on(rows, group, order).select(F.col("part").alias("_part"), F.col(group).alias("_group"), "carried")
    both = inner.join(carry, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return both.select(group, order, F.coalesce("_own", "carried").alias(out))
