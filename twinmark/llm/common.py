"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this subpackage: space and \\x09-\\x0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder; a cluster without it is an error,
    since a machine-local folder would lose rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="twinmark-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of earlier stages), and every later
    use reads the small columnar file instead of running the plan again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later job reads, whatever file system the shared folder is on."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, rows: int = 512):
    """The same rows in smaller record batches, so that a task holds few whole texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the scan's columns are pruned by what the caller selects."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array of strings; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda w: w != "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... within each ``group``, without gaps.

    ``rows`` is a stored table whose column ``part`` holds the task that wrote the row.  Rows are numbered
    by group and part, which a task has written and a task can sort, and the counts of the parts before
    are added; so a group of any size is spread over its parts.
    """
    counts = stored(rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "part").orderBy(*order)
    return rows.withColumn("_own", F.row_number().over(inside) - 1).join(starts, [group, "part"]) \
        .withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before")
