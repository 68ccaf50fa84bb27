"""Queries whose core runs in Arrow UDFs (rows-only checks; hand values in tests/)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extractors as XT
from ..operators import udf_jobs as UJ
from ..sources import pairs as P
from ..sources.tables import table
from .catalog import query

CK = ["conv_id", "turn"]


@query("stem_text", None, ("P4",))
def stem_text(spark, sf):
    """P4 over every conversation turn (lower-cased by the stemmer)."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return UJ.stem_job(c, CK, "text")


@query("longest_match", None, ("I3", "I4"))
def longest_match(spark, sf):
    return UJ.longest_match(P.conv_pairs(spark, sf), CK)


@query("compression_distance", None, ("I6",))
def compression_distance(spark, sf):
    return UJ.compression_distance(P.conv_pairs(spark, sf), CK)


@query("fuzzy_ratios", None, ("E6", "E7"))
def fuzzy_ratios(spark, sf):
    return UJ.fuzzy_ratios(P.conv_pairs(spark, sf), CK)


@query("negation_stemmed", None, ("E1 stemmed=True", "P4", "Q2"))
def negation_stemmed(spark, sf):
    return UJ.negation_stemmed(P.conv_pairs(spark, sf), CK)


JARO_SQL = """SELECT p_partkey, round(jaro_similarity(p_name, b), 9) AS jaro, round(jaro_winkler_similarity(p_name, b), 9) AS jaro_winkler
FROM (SELECT p_partkey, p_name, p_brand || ' ' || p_type AS b FROM part)"""


@query("python_features", JARO_SQL, ("X1 (user code in Python)",))
def python_features(spark, sf):
    """A registered Python extractor (Jaro, Jaro-Winkler) over part names and their brand and type."""
    pairs = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", F.col("p_name").alias("s1"), F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("s2"))
    out = XT.extract(pairs, ["p_partkey"], ["Jaro"])
    return out.select("p_partkey", F.round("jaro", 9).alias("jaro"), F.round("jaro_winkler", 9).alias("jaro_winkler"))
