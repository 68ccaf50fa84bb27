"""Text cleaning, tokenising and token filters as Column expressions.

Every function takes and returns a ``Column`` so Catalyst keeps them inside codegen (string
functions) or higher-order functions (arrays); nothing here calls Python per row.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
#
# Whitespace: the characters Python's ``str.split()`` splits on (``str.isspace``), so the token
# rule equals a bare ``split()``.  Written as a regex class body usable by Java and RE2.
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# An inverted question mark followed by exactly one ASCII punctuation character (backslash is
# not in the set; see SURVEY Q1), then both question marks trimmed from the ends.
P1_PATTERN = "¿[!\"#$%&\\x27()*+,\\-./:;<=>?@\\[\\]^_\\x60{|}~]"
P1_TRIM = "¿?"
# Every run of ASCII punctuation (backslash excluded) and both inverted marks.
P2_PATTERN = "[!\"#$%&\\x27()*+,\\-./:;<=>?@\\[\\]^_\\x60{|}~¿¡]+"
# Words (letters, digits, underscore) and single punctuation characters as tokens.
P6_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Negation words counted by the negation feature.
NEGATORS = ("no", "ni", "nunca")
# ---------------------------------------------------------------------------------------------

TOKEN_PATTERN = f"[^{WS_CLASS}]+"
# The whitespace characters of WS_CLASS outside Java's ``\s`` ([ \t\n\x0B\f\r]); mapping them to a
# blank first lets the tokeniser use ``\S+``, which Java matches several times faster than the
# equivalent explicit class (same tokens).
EXTRA_WS = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
# All characters of WS_CLASS.
WS_CHARS = " \t\n\x0b\f\r" + EXTRA_WS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_punct_paired(s) -> Column:
    """Delete inverted-mark + one punctuation char, trim inverted/plain question marks, lower."""
    return F.lower(F.btrim(F.regexp_replace(_col(s), P1_PATTERN, ""), F.lit(P1_TRIM)))


def strip_punct_all(s) -> Column:
    """Delete runs of ASCII punctuation and both inverted marks; case kept."""
    return F.regexp_replace(_col(s), P2_PATTERN, "")


def lower(s) -> Column:
    """P3."""
    return F.lower(_col(s))


def tokens_ws(s) -> Column:
    """P5: whitespace tokens, empties dropped (Python ``split()``, i.e. ``[^WS_CLASS]+``)."""
    normalised = F.translate(_col(s), EXTRA_WS, " " * len(EXTRA_WS))
    return F.regexp_extract_all(normalised, F.lit(r"\S+"), 0)


def tokens_word(s) -> Column:
    """Word and punctuation tokens (stand-in for Treebank word tokenising)."""
    return F.regexp_extract_all(_col(s), F.lit(P6_PATTERN), 0)


def as_text(x) -> Column:
    """Cast to string and strip surrounding whitespace (Python ``str(x).strip()``)."""
    return F.btrim(_col(x).cast("string"), F.lit(WS_CHARS))


def label_int(x) -> Column:
    """``int(label)``; values that are not integers become NULL (routed to rejects)."""
    return _col(x).cast("string").try_cast("int")


@functools.lru_cache(maxsize=None)
def stop_words(lang: str = "spanish") -> tuple[str, ...]:
    """The stop-word list Spark ships (``StopWordsRemover.loadDefaultStopWords``).

    Read from the mllib jar so the same list can be inlined into the DuckDB oracle without a JVM.
    """
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = f"org/apache/spark/ml/feature/stopwords/{lang}.txt"
            if name in z.namelist():
                return tuple(w for w in z.read(name).decode("utf-8").split("\n") if w)
    from pyspark.ml.feature import StopWordsRemover  # needs an active session

    return tuple(StopWordsRemover.loadDefaultStopWords(lang))


def remove_stopwords(tokens, lang: str = "spanish", words=None) -> Column:
    """drop stop words, keep order and repeats.

    ``isin`` over a literal list becomes an ``InSet`` (hash lookup) inside the lambda.
    """
    stops = list(words if words is not None else stop_words(lang))
    return F.filter(_col(tokens), lambda x: ~x.isin(stops))


def content_words(tokens, lang: str = "spanish", min_keep: int = 3, words=None) -> Column:
    """stop words removed only if at least ``min_keep`` tokens remain; else the original list.

    Pass a column reference (not a tokenising expression): the list appears in both branches.
    """
    t = _col(tokens)
    f = remove_stopwords(t, lang, words)
    return F.when(F.size(f) < min_keep, t).otherwise(f)


def with_content_words(df, text_col: str, out: str, lang: str = "spanish", min_keep: int = 3):
    """F2 over the tokens of ``lower(text_col)``, with tokens and filtered tokens projected once."""
    d = df.withColumn("_t", tokens_ws(lower(text_col)))
    d = d.withColumn("_f", remove_stopwords("_t", lang))
    return d.withColumn(out, F.when(F.size("_f") < min_keep, F.col("_t")).otherwise(F.col("_f"))).drop("_t", "_f")


def is_finite(x) -> Column:
    """F4 predicate: not NaN and not +-infinity (NULL counts as finite = absent)."""
    c = _col(x)
    return ~(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def count_parts(g, sep: str) -> Column:
    """Number of pieces of ``g.split(sep)`` (non-overlapping, left to right)."""
    g = _col(g)
    return F.floor((F.length(g) - F.length(F.replace(g, F.lit(sep), F.lit("")))) / len(sep)) + 1


def keep_grams_of_length(grams, n: int, sep: str) -> Column:
    """keep grams made of exactly ``n`` parts."""
    return F.filter(_col(grams), lambda g: count_parts(g, sep) == n)


def count_tokens_in(tokens, words) -> Column:
    """Occurrences of any of ``words`` in a token array (E1 counts)."""
    words = list(words)
    return F.size(F.filter(_col(tokens), lambda x: x.isin(words)))


def chars(s) -> Column:
    """Characters (code points) of a string as an array."""
    return F.regexp_extract_all(_col(s), F.lit("(?s)."), 0)
