"""The corpus pipeline: toxicity, quality rules, SimHash near-dedup, secret scans, best-fit packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` applies them in order, each to what is left of ``documents``, with every stage's result written
to the shared folder and read back, so no stage is computed twice and none depends on a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmark.llm import packing, quality, secret_scan, simhash, toxicity
from twinmark.llm.common import stored, table
from twinmark.llm.queries import TOXIC, tokenizer, toxicity_field


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.drop_toxic(docs, toxicity_field(spark, docs, sf_dir), TOXIC)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; lines above their host's limits go.

    Long lines are judged by the number of their documents alone, however large the host is.
    """
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id; groups go by text, whatever the ids are."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in it are masked.

    A repository is a distinct text, so a value copied all over one hot source is told from a live one.
    """
    return secret_scan.mask(docs, F.col("source"), secret_scan.text_key(F.col("text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end=0)


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_masks),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, fingerprints and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
