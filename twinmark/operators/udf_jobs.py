"""Jobs whose per-value core is Python.

Each does the relational part in Spark and hands Python only what it needs: distinct words
(stemming), distinct string pairs (longest match, compression, fuzzy ratios), and for E6 only the
pairs that share no token (the rest are 100 natively).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow_udfs as U
from ..functions import text as T
from ..functions import distance as D


def stem_job(df: DataFrame, keys: list[str], text: str, out: str = "stemmed") -> DataFrame:
    """Snowball-stem every whitespace token; tokens rejoined by single blanks.

    Distinct words are stemmed once ((word, stem) table), joined back to the exploded tokens and
    re-collected in position order.  Frequent words are one row of the table however often they
    occur; the join is broadcast by AQE when the table is small, else a shuffle join with skew
    splitting.
    """
    toks = df.select(*keys, F.posexplode_outer(T.tokens_ws(text)).alias("pos", "word"))
    stems = toks.where(F.col("word").isNotNull()).select("word").distinct().select("word", U.stem_udf("word").alias("stem"))
    keep = F.when(F.col("stem").isNotNull(), F.struct("pos", "stem"))
    joined = toks.join(stems, "word", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(keep)).alias("_s"))
    return joined.select(*keys, F.array_join(F.transform("_s", lambda s: s["stem"]), " ").alias(out))


def stem_tokens(df: DataFrame, keys: list[str], tok_col: str, out: str = "stemmed") -> DataFrame:
    """Stem every element of a token array column (order kept), each distinct word once."""
    toks = df.select(*keys, F.posexplode_outer(tok_col).alias("pos", "word"))
    stems = toks.where(F.col("word").isNotNull()).select("word").distinct().select("word", U.stem_udf("word").alias("stem"))
    keep = F.when(F.col("stem").isNotNull(), F.struct("pos", "stem"))
    agg = toks.join(stems, "word", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(keep)).alias("_s"))
    return agg.select(*keys, F.transform("_s", lambda s: s["stem"]).alias(out))


def negation_stemmed(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """E1 with the reference's literal order (Q2): word tokens are stemmed before counting, so
    'nunca' (stem 'nunc') never counts."""
    from . import features as X
    t = X.tokenise(pairs, keys)
    s1 = stem_tokens(t, keys, "wt1", "wt1")
    s2 = stem_tokens(t, keys, "wt2", "wt2")
    return s1.join(s2, keys).select(*keys, *X.negation_columns("wt1", "wt2"))


def _filled(pairs: DataFrame, keys: list[str], s1: str, s2: str) -> DataFrame:
    """Keys and both sides; an absent text is an empty one, as in every feature job."""
    return pairs.select(*keys, F.coalesce(F.col(s1), F.lit("")).alias(s1), F.coalesce(F.col(s2), F.lit("")).alias(s2))


def _per_distinct_pair(pairs: DataFrame, keys: list[str], a: Column, b: Column, udf, out: str) -> DataFrame:
    """Run a pair UDF once per distinct (a, b) value pair and join the result back."""
    v = pairs.select(*keys, a.alias("_a"), b.alias("_b"))
    scored = v.select("_a", "_b").distinct().select("_a", "_b", udf(F.col("_a"), F.col("_b")).alias(out))
    return v.join(scored, ["_a", "_b"]).drop("_a", "_b")


def longest_match(pairs: DataFrame, keys: list[str], s1: str = "s1", s2: str = "s2") -> DataFrame:
    """Longest matching block (blank as junk) and its ratio to the shorter length."""
    pairs = _filled(pairs, keys, s1, s2)
    out = _per_distinct_pair(pairs, keys, F.col(s1), F.col(s2), U.longest_match_size_udf, "longest_match")
    lens = pairs.select(*keys, F.least(F.length(s1), F.length(s2)).alias("_m"))
    return (out.join(lens, keys)
            .select(*keys, "longest_match", D.try_divide("longest_match", "_m").alias("longest_match_ratio")))


def compression_distance(pairs: DataFrame, keys: list[str], s1: str = "s1", s2: str = "s2") -> DataFrame:
    """Normalised compression distance with self lengths computed once per distinct text.

    Equal texts short-circuit to 0 without compressing anything.
    """
    pairs = _filled(pairs, keys, s1, s2)
    texts = pairs.select(F.col(s1).alias("t")).union(pairs.select(F.col(s2).alias("t"))).distinct()
    self_len = texts.select("t", U.lzma_len_udf("t").alias("l"))
    p = pairs.select(*keys, F.col(s1).alias("_a"), F.col(s2).alias("_b"))
    diff = p.where(F.col("_a") != F.col("_b"))
    both = diff.select("_a", "_b").distinct()
    both = both.select("_a", "_b", U.lzma_pair_len_udf("_a", "_b").alias("lxy"))
    la = self_len.select(F.col("t").alias("_a"), F.col("l").alias("la"))
    lb = self_len.select(F.col("t").alias("_b"), F.col("l").alias("lb"))
    scored = both.join(la, "_a").join(lb, "_b").select(
        "_a", "_b", D.try_divide(F.col("lxy") - F.least("la", "lb"), F.greatest("la", "lb")).alias("compression_dist"))
    return (p.join(scored, ["_a", "_b"], "left")
            .select(*keys, F.when(F.col("_a") == F.col("_b"), F.lit(0.0))
                    .otherwise(F.col("compression_dist")).alias("compression_dist")))


# fuzzy-ratio cleaning: fixed values
HIGH_LATIN = "[\\x{80}-\\x{FF}]"
NON_WORD = "[^\\p{L}\\p{N}_]+"


def fuzzy_tokens(text) -> Column:
    """Cleaned tokens of the distinct whitespace tokens of lower(text) (repeats from cleaning kept)."""
    raw = F.array_distinct(T.tokens_ws(T.lower(text)))
    cleaned = F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(t, HIGH_LATIN, ""), NON_WORD, " "))
    return T.tokens_ws(F.array_join(cleaned, " "))


def fuzzy_ratios(pairs: DataFrame, keys: list[str], s1: str = "s1", s2: str = "s2") -> DataFrame:
    """E6 (partial token set ratio) and E7 (partial token sort ratio), 0..100.

    E6 is 100 natively whenever the cleaned token sets overlap; otherwise, like E7, it is the
    partial ratio of two sorted token strings, computed in Python once per distinct key pair.
    """
    pairs = _filled(pairs, keys, s1, s2)
    t = pairs.select(*keys, fuzzy_tokens(s1).alias("c1"), fuzzy_tokens(s2).alias("c2"))
    t = t.select(*keys, "c1", "c2",
                 F.array_join(F.array_sort(F.array_distinct("c1")), " ").alias("set1"),
                 F.array_join(F.array_sort(F.array_distinct("c2")), " ").alias("set2"),
                 F.array_join(F.array_sort("c1"), " ").alias("sort1"),
                 F.array_join(F.array_sort("c2"), " ").alias("sort2"),
                 F.arrays_overlap("c1", "c2").alias("overlap")).persist()
    native = t.where(F.col("overlap")).select(*keys, F.lit(100).cast("long").alias("partial_token_set_ratio"))
    rest = _per_distinct_pair(t.where(~F.col("overlap")), keys, F.col("set1"), F.col("set2"),
                              U.partial_ratio_udf, "partial_token_set_ratio")
    e6 = native.unionByName(rest)
    e7 = _per_distinct_pair(t, keys, F.col("sort1"), F.col("sort2"), U.partial_ratio_udf, "partial_token_sort_ratio")
    return e6.join(e7, keys)
