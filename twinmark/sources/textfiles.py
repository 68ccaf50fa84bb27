"""Pair and vector text files (S1-S6, S14): fixed layouts read with explicit schemas.

Readers return ``(rows, rejects)`` where a line does not have the fields the layout needs; the
reference raises on such lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import read_lines

TSV5 = ["s1", "translated1", "s2", "translated2", "label"]
TSV5_SWAPPED = ["translated1", "s1", "translated2", "s2", "label"]


def _fields(spark, path, sep_regex):
    ln = read_lines(spark, path, strip=True)
    return ln.select("pos", F.split("value", sep_regex).alias("f"), "value")


def read_pairs_csv(spark: SparkSession, path, preprocess: bool = False, stem: bool = False):
    """``label,s1,s2`` lines split naively on commas (fields 0, 1, 2; extra fields ignored).
    ``preprocess`` applies P1 (and ``stem`` P4) as the reference's preprocessing does."""
    f = _fields(spark, path, ",")
    ok = f.where(F.size("f") >= 3)
    rows = ok.select(F.col("pos").alias("pair_id"), F.get("f", 0).alias("label"),
                     F.get("f", 1).alias("s1"), F.get("f", 2).alias("s2"))
    if preprocess:
        rows = rows.withColumn("s1", T.strip_punct_paired("s1")).withColumn("s2", T.strip_punct_paired("s2"))
        if stem:
            from ..operators.udf_jobs import stem_job
            for s in ("s1", "s2"):
                st = stem_job(rows, ["pair_id"], s, out=f"_{s}")
                rows = rows.join(st, "pair_id").drop(s).withColumnRenamed(f"_{s}", s)
    return rows.select("pair_id", "s1", "s2", "label"), f.where(F.size("f") < 3).select("pos", "value")


def read_pairs_tsv5(spark: SparkSession, path, swapped: bool = False):
    """S2 / S3 layouts: five tab-separated fields; keeps s1, s2 and label."""
    cols = TSV5_SWAPPED if swapped else TSV5
    f = _fields(spark, path, "\t")
    ok = f.where(F.size("f") >= 5).select("pos", *[F.get("f", i).alias(c) for i, c in enumerate(cols)])
    return (ok.select(F.col("pos").alias("pair_id"), "s1", "s2", "label"),
            f.where(F.size("f") < 5).select("pos", "value"))


def read_bilingual_pairs(spark: SparkSession, path_a, path_b) -> DataFrame:
    """S3: the two column orders stacked (``unionByName``), translated columns dropped; pair ids
    of the second file continue after the first's."""
    a, _ = read_pairs_tsv5(spark, path_a, swapped=True)
    b, _ = read_pairs_tsv5(spark, path_b, swapped=False)
    off = a.agg(F.coalesce(F.max("pair_id") + 1, F.lit(0))).scalar()
    return a.unionByName(b.withColumn("pair_id", F.col("pair_id") + off))


def read_test_pairs(spark: SparkSession, path) -> DataFrame:
    """Two tab-separated sentences; ``label = -1``, ``test_id`` = line position."""
    f = _fields(spark, path, "\t")
    return f.select(F.col("pos").alias("test_id"), F.get("f", 0).alias("s1"), F.get("f", 1).alias("s2"),
                    F.lit(-1).alias("label"))


def read_pair_table(spark: SparkSession, path, s1: str = "spanish_sentence1", s2: str = "spanish_sentence2",
                    label: str | None = "is_duplicate", multiline: bool = False) -> DataFrame:
    """Headered CSV with an explicit schema; NULL text becomes ''.

    A file is split over tasks unless ``multiline`` says that quoted fields hold line breaks.
    """
    schema = f"`{s1}` STRING, `{s2}` STRING" + (f", `{label}` STRING" if label else "")
    df = spark.read.csv(path, header=True, schema=schema, multiLine=multiline, escape='"')
    df = df.na.fill("", subset=[s1, s2])
    out = df.select(F.col(s1).alias("s1"), F.col(s2).alias("s2"),
                    *([T.label_int(label).alias("label")] if label else []))
    return out


def write_pairs_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV of the pair table."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def read_word_vectors(spark: SparkSession, path) -> DataFrame:
    """``word v1 .. vd`` lines; the last line of a repeated word wins."""
    ln = read_lines(spark, path, strip=True)
    f = ln.select("pos", T.tokens_ws("value").alias("f")).where(F.size("f") >= 2)
    v = f.select("pos", F.get("f", 0).alias("word"),
                 F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.cast("float")).alias("vec"))
    return v.groupBy("word").agg(F.max_by("vec", "pos").alias("vec"))


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)
