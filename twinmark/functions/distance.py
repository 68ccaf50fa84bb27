"""Distances, set similarities and maths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import plain_grams


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_divide(x, y, val: float = 0.0) -> Column:
    """X / y, ``val`` when y is 0 (or NULL)."""
    return F.coalesce(_col(x).cast("double") / F.nullif(_col(y).cast("double"), F.lit(0.0)),
                      F.lit(float(val)))


def n_gram_overlap(a, b, n: int) -> Column:
    """|A & B| / (|A| + |B|) over separator-less n-gram sets, no fallback; 0 if both empty."""
    ga, gb = plain_grams(a, n), plain_grams(b, n)
    return try_divide(F.size(F.array_intersect(ga, gb)), F.size(ga) + F.size(gb))


def edit_dist(a, b) -> Column:
    """Levenshtein distance / longer length; 0 when both are empty."""
    a, b = _col(a), _col(b)
    return try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def is_str_match(a, b, threshold: float = 1.0) -> Column:
    """equality at threshold 1, else ``1 - edit_dist >= threshold``."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [0, 1]")
    a, b = _col(a), _col(b)
    if threshold == 1.0:
        return a == b
    return (F.lit(1.0) - edit_dist(a, b)) >= F.lit(float(threshold))


def jaccard(a, b) -> Column:
    """|A & B| / |A | B| over distinct elements; 0 when both empty."""
    a, b = _col(a), _col(b)
    return try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dice(a, b) -> Column:
    """I8: 2 |A & B| / (|A| + |B|) over distinct elements."""
    a, b = _col(a), _col(b)
    return try_divide(2 * F.size(F.array_intersect(a, b)),
                      F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def dot(v1, v2) -> Column:
    """Left-to-right dot product of two equally long numeric arrays."""
    return F.aggregate(F.zip_with(_col(v1), _col(v2), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine_sim(v1, v2) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    return try_divide(dot(v1, v2), norm(v1) * norm(v2))


def count_one_bits(x) -> Column:
    """I10."""
    return F.bit_count(_col(x))


def int_to_binary(x) -> Column:
    """Binary digits, 0 -> empty string."""
    x = _col(x)
    return F.when(x == 0, F.lit("")).otherwise(F.bin(x))


def cut_prob(p) -> Column:
    """Clip to [1e-15, 1 - 1e-15]."""
    return F.least(F.greatest(_col(p).cast("double"), F.lit(1e-15)), F.lit(1.0 - 1e-15))


def logit(p) -> Column:
    """log(p / (1 - p)) after clipping."""
    c = cut_prob(p)
    return F.ln(c / (F.lit(1.0) - c))


def logistic(y) -> Column:
    """exp(y) / (1 + exp(y)) written in the overflow-safe form."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(y).cast("double")))


def char_length(s) -> Column:
    """I15 (characters)."""
    return F.length(_col(s))


def round4(x) -> Column:
    """I16 display option: 4 decimals, half-even."""
    return F.bround(_col(x), 4)
