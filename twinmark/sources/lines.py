"""Text lines with their exact position, from a distributed text scan (W4 for text sources).

``spark.read.text`` splits large files across tasks and packs small files together.  Within a
split, lines keep their order; splits of one file come in partition order.  The position of a line
is therefore (file rank, lines in earlier splits of the file, index inside the split).  Only a
small table with one row per (file, split) is ordered; no file passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The table of splits is broadcast up to this many of them; a larger one is joined by a shuffle.
BROADCAST_SPLITS = 50_000


def read_lines(spark: SparkSession, path, strip: bool = False) -> DataFrame:
    """(file, line_no, pos, value): ``line_no`` counts from 0 within the file, ``pos`` across all
    files in the order of names and part numbers (so ``part-00000``, ``part-00001`` ... read as one
    stream)."""
    paths = [path] if isinstance(path, str) else list(path)
    d = (spark.read.text(paths)
         .select(F.input_file_name().alias("file"), F.spark_partition_id().alias("_pid"),
                 F.monotonically_increasing_id().alias("_mid"), "value"))
    d = d.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    splits = d.groupBy("file", "_pid").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w_file = Window.partitionBy("file").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(w_file), F.lit(0)))
    files = splits.groupBy("file").agg(F.sum("_n").alias("_fn"))
    # part numbers count as numbers: part-100000 comes behind part-99999
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1)
    w_all = Window.orderBy(F.regexp_replace("file", r"part-\d+([^/]*)$", "part-"), F.lpad(number, 20, "0"), "file")
    w_all = w_all.rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_fbefore", F.coalesce(F.sum("_fn").over(w_all), F.lit(0))).select("file", "_fbefore")
    meta = splits.join(files, "file")
    if d.rdd.getNumPartitions() <= BROADCAST_SPLITS:  # a row or two for each split, so its size is known
        meta = F.broadcast(meta)
    out = d.join(meta, ["file", "_pid"]).select(
        "file", (F.col("_before") + F.col("_local") - F.col("_first")).alias("line_no"),
        (F.col("_fbefore") + F.col("_before") + F.col("_local") - F.col("_first")).alias("pos"), "value")
    if strip:
        from ..functions.text import as_text
        out = out.withColumn("value", as_text("value"))
    return out


def write_lines(df: DataFrame, path: str, order_by: str | None = None, mode: str = "overwrite") -> None:
    """One line per row (``value``); with ``order_by`` the part files are range-sorted so
    their name order is the row order."""
    if order_by:
        df = df.repartitionByRange(order_by).sortWithinPartitions(order_by)
    df.select("value").write.mode(mode).text(path)
