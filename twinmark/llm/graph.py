"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _pairs(df: DataFrame) -> DataFrame:
    """Rows (big, small), each once, without loops."""
    return (df.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct())


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns (node, component): every linked node with the smallest node that it reaches.

    Each round lets every node pass its smallest neighbour to its larger neighbours (large star), then
    to its smaller ones (small star); the number of rounds grows with the logarithm of a component's
    length.  Minima are pre-aggregated before they are shuffled, and each round's links are written to
    the shared folder, so no lineage builds up and nothing is gathered by the driver but a checksum.
    Null ends are ignored; nodes without a link to another node are not returned; an empty table gives
    an empty result.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    now = stored(_pairs(pairs), "links")
    mark = _mark(now)
    while mark[0]:
        ends = now.select(F.col("big").alias("n"), F.col("small").alias("o")).union(
            now.select(F.col("small").alias("n"), F.col("big").alias("o")))
        least = ends.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = _pairs(now.join(least, now["small"] == least["n"]).select(F.col("big").alias("a"), F.col("m").alias("b")))
        root = large.groupBy(F.col("big").alias("n")).agg(F.min("small").alias("m"))
        small = large.join(root, large["big"] == root["n"]).select(
            F.explode(F.array(F.col("big"), F.col("small"))).alias("a"), F.col("m").alias("b"))
        now = stored(_pairs(small), "links")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).union(roots)
