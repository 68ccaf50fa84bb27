"""Pair views over the driver tables (FIXTURES.md).

A pair table has key columns plus ``s1`` and ``s2`` (and optionally ``label``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbors import previous_in_group
from .tables import table

CONV_KEYS = ["conv_id", "turn"]
DOC_KEYS = ["pair_id"]


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it.

    Equi-join on (conv_id, turn + 1): both sides shuffle on a unique key, so no skew.
    """
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    a = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("s1"))
    b = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s2"))
    return a.join(b, ["conv_id", "turn"], "inner").select("conv_id", "turn", "s1", "s2")


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, prev_id, lang): each document with the previous doc_id of its language; no text is read."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    prev = previous_in_group(docs, "lang", "doc_id", out="prev_id").where(F.col("prev_id").isNotNull())
    return prev.select(F.col("doc_id").alias("pair_id"), "prev_id", "lang")


def with_labels(links: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``links`` with ``label`` and ``split``: 'train' when both documents are labelled (label = same
    quality), else 'test' with label -1 (the reference's test rows)."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    l1 = lab.select(F.col("doc_id").alias("prev_id"), F.col("quality").alias("q1"))
    l2 = lab.select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("q2"))
    both = F.col("q1").isNotNull() & F.col("q2").isNotNull()
    return (links.join(l1, "prev_id", "left").join(l2, "pair_id", "left")
            .withColumn("label", F.when(both, (F.col("q1") == F.col("q2")).cast("int")).otherwise(F.lit(-1)))
            .withColumn("split", F.when(both, F.lit("train")).otherwise(F.lit("test")))
            .drop("q1", "q2"))


def with_texts(links: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``links`` with s1 (of ``prev_id``) and s2 (of ``pair_id``)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    d1 = docs.select(F.col("doc_id").alias("prev_id"), F.col("text").alias("s1"))
    d2 = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("s2"))
    return links.join(d1, "prev_id").join(d2, "pair_id")


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the previous doc_id of its language; ``pair_id`` is the later doc_id."""
    return with_texts(doc_links(spark, sf_dir), spark, sf_dir).select("pair_id", "prev_id", "lang", "s1", "s2")


def linked_sentences(links: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """U2 over ``with_texts(links)`` without its texts in pairs: (s), the distinct texts of both sides, an absent one as empty; and its number of rows.

    Hashes find the first document of each text; a text is shuffled once, by its document.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("s"))
    named = docs.withColumn("h", F.sha2("s", 256))
    ends = links.select(F.explode(F.array("prev_id", "pair_id")).alias("doc_id")).distinct()
    first = named.select("doc_id", "h").join(ends, "doc_id", "left_semi").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    sentences = named.join(first, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("s")
    ids = docs.select("doc_id")
    rows = links.select("prev_id", "pair_id").join(ids.withColumnRenamed("doc_id", "prev_id"), "prev_id").join(ids.withColumnRenamed("doc_id", "pair_id"), "pair_id")
    return sentences, rows.agg(F.count(F.lit(1)).cast("double")).scalar()


def split_doc_pairs(spark: SparkSession, sf_dir: str, links: DataFrame | None = None) -> DataFrame:
    """``doc_pairs`` with ``label`` and ``split``; labels are joined before the texts (``links``: the links with them)."""
    out = with_texts(with_labels(doc_links(spark, sf_dir), spark, sf_dir) if links is None else links, spark, sf_dir)
    return out.select("pair_id", "prev_id", "lang", "s1", "s2", "label", "split")


def labelled_doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_pairs`` where both documents are labelled; label = same quality (synthetic is_duplicate)."""
    links = with_labels(doc_links(spark, sf_dir), spark, sf_dir).where("split = 'train'").drop("split")
    return with_texts(links, spark, sf_dir).select("pair_id", "prev_id", "lang", "s1", "s2", "label")


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vector table (word, vec): the word ranked i-th by frequency over all document tokens
    (count desc, word asc; i from 1) owns ``embeddings.vec_id = i - 1``.  Words ranked past the
    embedding rows have no vector."""
    from ..functions import text as T
    from ..functions.arrow_udfs import count_words
    from ..operators.corpus import rank_counts

    docs = table(spark, sf_dir, "documents", "text")
    ranked = rank_counts(count_words(docs.select(F.coalesce(T.lower("text"), F.lit("")).alias("t"), F.lit(1).alias("w"))))
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ranked.join(emb, ranked["idx"] - 1 == emb["vec_id"]).select("word", F.col("embedding").alias("vec"))
