"""Pair-feature queries (E1-E10) and the feature registry.

Input: a pair table with key columns and ``s1``, ``s2`` (``label`` optional).  Output: the keys
plus named DOUBLE / BIGINT feature columns.  Stateless features are one ``select`` over a table that
is tokenised once (``tokenise``); TF-IDF is a corpus job joined back on the keys.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..functions.arrow_udfs import bag_udf, count_words, lcs_len_udf, n_words_udf, ngram_jaccard_udf
from ..session import cut_lineage


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------------------------------ tokens

def filled(pairs: DataFrame) -> DataFrame:
    """``pairs`` with absent texts as empty ones: the contract of every feature."""
    return pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("s1", "s2")})


def tokenise(pairs: DataFrame, keys: list[str], lang: str = "spanish") -> DataFrame:
    """Tokenise both sides once; every stateless feature reads these columns.  An absent text is an empty one.

    ws1/ws2: whitespace tokens of the lower-cased text (P3 + P5);
    wt1/wt2: word/punctuation tokens of the lower-cased stripped text (P7 + P3 + P6);
    sw1/sw2: ws tokens without stop words (F1).
    """
    out = filled(pairs).select(
        *keys, "s1", "s2",
        T.tokens_ws(T.lower("s1")).alias("ws1"), T.tokens_ws(T.lower("s2")).alias("ws2"),
        T.tokens_word(T.lower(T.as_text("s1"))).alias("wt1"),
        T.tokens_word(T.lower(T.as_text("s2"))).alias("wt2"),
        *(["label"] if "label" in pairs.columns else []))
    return out.select("*", T.remove_stopwords("ws1", lang).alias("sw1"),
                      T.remove_stopwords("ws2", lang).alias("sw2"))


# ---------------------------------------------------------------------------- column expressions

def negation_columns(wt1="wt1", wt2="wt2", negators=T.NEGATORS) -> list[Column]:
    """E1 (6 outputs) over unstemmed lower-case word tokens."""
    c1 = T.count_tokens_in(wt1, negators).cast("long")
    c2 = T.count_tokens_in(wt2, negators).cast("long")
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return [c1.alias("not_cnt1"), c2.alias("not_cnt2"),
            flag((c1 > 0) & (c2 > 0)).alias("not_both"),
            flag((c1 > 0) | (c2 > 0)).alias("not_any"),
            flag(((c2 <= 0) & (c1 > 0)) | ((c1 <= 0) & (c2 > 0))).alias("not_one"),
            flag(F.abs(c1 - c2) % 2 == 0).alias("not_same_parity")]


def shared_count(w1, w2) -> Column:
    """Occurrences of w1 tokens that also occur in w2 (inline form, O(|w1|*|w2|) per pair)."""
    w1, w2 = _col(w1), _col(w2)
    return F.size(F.filter(w1, lambda x: F.array_contains(w2, x)))


def word_match_share(sw1="sw1", sw2="sw2") -> Column:
    """(shared occurrences both ways) / all non-stop occurrences; 0 when there are none."""
    return D.try_divide(shared_count(sw1, sw2) + shared_count(sw2, sw1),
                        F.size(_col(sw1)) + F.size(_col(sw2))).alias("word_match_share")


def length_columns(s1="s1", s2="s2", ws1="ws1", ws2="ws2", batched: bool = False) -> list[Column]:
    """E3 (6 outputs): characters and whitespace words of each side and their differences; with ``batched``
    words are counted in an Arrow batch (long texts), not by the size of ws1 and ws2."""
    l1, l2 = F.length(_col(s1)).cast("long"), F.length(_col(s2)).cast("long")
    n1, n2 = [n_words_udf(_col(s)) for s in (s1, s2)] if batched else [F.size(_col(w)).cast("long") for w in (ws1, ws2)]
    return [l1.alias("len_char1"), l2.alias("len_char2"), n1.alias("len_word1"),
            n2.alias("len_word2"), F.abs(l1 - l2).alias("len_char_diff"),
            F.abs(n1 - n2).alias("len_word_diff")]


def ngram_jaccard_columns(wt1="wt1", wt2="wt2", orders=(1, 2, 3)) -> list[Column]:
    """Jaccard of word n-grams (with fallback) for each order, counted in an Arrow batch."""
    met = ngram_jaccard_udf(tuple(orders))(F.array_join(_col(wt1), " "), F.array_join(_col(wt2), " "))  # no token holds a blank
    return [F.get(met, F.lit(i)).alias(f"ngram_jaccard_{n}") for i, n in enumerate(orders)]


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two token arrays.

    DP row update in prefix-maximum form: with ``prev`` non-decreasing,
    ``cur[j] = max(prev[j], prev[k] + 1)`` where k is the last position < j with b[k] = a_i.
    Rows where a_i does not occur in b are copied, so the cost is O(|a| + |b| * matches).
    """
    a, b = _col(a), _col(b)
    lb = F.size(b)

    def step(prev, w):
        hits = F.filter(F.sequence(F.lit(0), lb - 1), lambda k: F.get(b, k) == w)
        row = F.transform(
            F.sequence(F.lit(0), lb),
            lambda j: F.when(j == 0, F.lit(0)).otherwise(F.greatest(
                F.get(prev, j),
                F.aggregate(hits, F.lit(0),
                            lambda acc, k: F.when(k < j, F.get(prev, k) + 1).otherwise(acc)))))
        return F.when(F.size(hits) == 0, prev).otherwise(row)

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), lb + 1), step), -1)


def lcs_ratio(ws1="ws1", ws2="ws2", method: str = "arrow") -> Column:
    """E5: LCS of whitespace words / (len1 + len2), 0 when both are empty (true LCS, see Q3).

    ``method="arrow"`` runs the row DP in numpy inside an Arrow UDF (fast on long sentences);
    ``method="hof"`` keeps it in Spark higher-order functions (no Python workers; short arrays).
    """
    if method == "hof":
        n = lcs_length(ws1, ws2)
    else:
        n = lcs_len_udf(_col(ws1), _col(ws2))
    return D.try_divide(n, F.size(_col(ws1)) + F.size(_col(ws2))).alias("lcs_ratio")


def label_column(label="label") -> Column:
    """E9."""
    return T.label_int(label).alias("label")


# ------------------------------------------------------------------------------- DataFrame jobs

def negation_features(pairs, keys):
    t = tokenise(pairs, keys)
    return t.select(*keys, *negation_columns())


def word_match_share_features(pairs, keys, lang="spanish"):
    t = tokenise(pairs, keys, lang)
    return t.select(*keys, word_match_share())


def length_features(pairs, keys):
    t = tokenise(pairs, keys)
    return t.select(*keys, *length_columns())


def ngram_jaccard_features(pairs, keys):
    t = tokenise(pairs, keys)
    return t.select(*keys, *ngram_jaccard_columns())


def lcs_features(pairs, keys, method: str = "arrow"):
    t = tokenise(pairs, keys).select(*keys, "ws1", "ws2")
    return t.select(*keys, lcs_ratio(method=method))


def word_match_share_exploded(pairs: DataFrame, keys: list[str], lang: str = "spanish") -> DataFrame:
    """E2 for long texts (D2): per-pair word bags aggregated relationally instead of O(n*m) arrays."""
    return bag_features(pairs, keys, lang=lang, with_tfidf=False)


# ------------------------------------------------------------------------------------- TF-IDF

def distinct_sentences(pairs: DataFrame) -> DataFrame:
    """Distinct sentences across both sides (case-sensitive), from one pass over the pairs."""
    return pairs.select(F.explode(F.array("s1", "s2")).alias("s")).distinct()


def corpus_idf(pairs: DataFrame) -> DataFrame:
    """``log2(N / (cf + 1))`` with cf the collection frequency over distinct sentences and N the
    number of pair rows (Q5).  Words are counted batch by batch before they are shuffled."""
    pairs = filled(pairs)
    return sentence_idf(distinct_sentences(pairs), pairs.agg(F.count(F.lit(1)).cast("double")).scalar())


def sentence_idf(sentences: DataFrame, n_rows: Column) -> DataFrame:
    """``corpus_idf`` from the distinct sentences (s) and the number of pair rows."""
    counts = count_words(sentences.select(T.lower("s").alias("t"), F.lit(1).alias("w")))
    return counts.select("word", F.log2(n_rows / (F.col("n") + F.lit(1.0))).alias("idf"))


#: Words whose idf is looked up where the pair is; the idf of rarer words is joined.
COMMON_WORDS = 100_000


def _bags(grouped: DataFrame, keys: list[str], carried: list[str], idf: DataFrame | None, lang: str, null_keys: bool = True) -> DataFrame:
    """(keys, carried, features of ``bag_features``) of rows that hold all texts of their key as s1 and s2.

    Without ``null_keys`` rare words of a key that is null, or partly, are left out; rows that are dealt by their keys then stay where they are.
    """
    lookup, rare = None, False
    if idf is not None:
        common = idf.select("word", "idf").orderBy("idf", "word").limit(COMMON_WORDS + 1).collect()
        rare = len(common) > COMMON_WORDS
        lookup = grouped.sparkSession.sparkContext.broadcast({r.word: r.idf for r in common[:COMMON_WORDS]})
    of = lambda rare: bag_udf(lookup, rare, T.stop_words(lang))(T.lower("s1"), T.lower("s2")).alias("_b")
    if rare:  # their sums come back to the texts before the bags are made: behind Python, Spark takes rows for not dealt by key
        met = grouped.select(*keys, of(True)).select(*keys, F.explode(F.arrays_zip("_b.side", "_b.word", "_b.tf")).alias("_r"))
        met = met.select(*keys, "_r.*").join(idf.select("word", "idf"), "word")
        part = lambda side: F.sum(F.when(F.col("side") == side, F.col("tf") * F.col("idf"))).alias(f"_more{side}")
        more = met.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(part(1), part(2))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if null_keys else F.col(k) == F.col(f"_{k}") for k in keys]
        grouped = grouped.join(more, same, "left").drop(*[f"_{k}" for k in keys])
    bags = grouped.select(*keys, *carried, *(["_more1", "_more2"] if rare else []), of(False))
    out = bags.select(*keys, *carried, D.try_divide("_b.shared", "_b.total").alias("word_match_share"),
                      *([F.col(f"_b.sum{i}") + F.coalesce(f"_more{i}" if rare else F.lit(0.0), F.lit(0.0)) for i in (1, 2)] if idf is not None else []),
                      "_b.n1", "_b.n2")
    if idf is None:
        return out.drop("n1", "n2")
    out = out.toDF(*keys, *carried, "word_match_share", "_s1", "_s2", "_n1", "_n2")
    a1, a2 = D.try_divide("_s1", "_n1"), D.try_divide("_s2", "_n2")
    return out.select(*keys, *carried, "word_match_share", F.col("_s1").alias("tfidf_sum1"), F.col("_s2").alias("tfidf_sum2"),
                      a1.alias("tfidf_mean1"), a2.alias("tfidf_mean2"), F.abs(F.col("_s1") - F.col("_s2")).alias("tfidf_sum_diff"),
                      F.abs(a1 - a2).alias("tfidf_mean_diff"))


def _idf_of(pairs: DataFrame, idf: DataFrame | None) -> DataFrame:
    """The given idf table, or the one of these pairs, stored: it is read more than once."""
    return cut_lineage(corpus_idf(pairs)) if idf is None else idf


def bag_features(pairs: DataFrame, keys: list[str], idf: DataFrame | None = None, lang: str = "spanish",
                 with_tfidf: bool = True) -> DataFrame:
    """E2 and E8 from one bag-of-words job (G1 tf, D1 idf lookup with default 0, G3 sums/means).

    The texts of a key are one row (a key that comes again adds its words), whose non-stop words are
    counted in an Arrow batch: no (pair, word) row is shuffled.  Words of both sides give the word match
    share; tf * idf sums give TF-IDF.  The idf of the ``COMMON_WORDS`` most frequent words, a fixed bound, is sent
    to the tasks; the words behind them leave their row and meet the idf table by a join on ``word``.
    """
    pairs = filled(pairs)
    grouped = pairs.groupBy(*keys).agg(*[F.array_join(F.collect_list(s), " ").alias(s) for s in ("s1", "s2")])
    return _bags(grouped, keys, [], _idf_of(pairs, idf) if with_tfidf else None, lang)


def tfidf_features(pairs: DataFrame, keys: list[str], idf: DataFrame | None = None,
                   lang: str = "spanish") -> DataFrame:
    """E8 (6 outputs); see ``bag_features``."""
    return bag_features(pairs, keys, idf, lang).drop("word_match_share")


# ----------------------------------------------------------------------- registry

@dataclass(frozen=True)
class Extractor:
    """A named feature: ``columns(t)`` maps the tokenised table to output columns."""
    name: str
    n_out: int
    columns: Callable[[], list[Column]]


REGISTRY: dict[str, Extractor] = {}


def register(name: str, n_out: int, columns: Callable[[], list[Column]]) -> Extractor:
    ex = Extractor(name, n_out, columns)
    REGISTRY[name] = ex
    return ex


register("Not", 6, negation_columns)
register("WordMatchShare", 1, lambda: [word_match_share()])
register("Length", 6, lambda: length_columns(batched=True))
register("NgramJaccardCoef", 3, ngram_jaccard_columns)
register("long_common_sequence", 1, lambda: [lcs_ratio()])

STATELESS = ("Not", "WordMatchShare", "Length", "NgramJaccardCoef", "long_common_sequence")


def pair_features(pairs: DataFrame, keys: list[str], features=STATELESS + ("TFIDFSpanish",),
                  lang: str = "spanish", idf: DataFrame | None = None) -> DataFrame:
    """Every selected feature in one pass (X3 selects by name); ``idf`` if it is not to be fitted on these pairs.

    The texts are read once: the bag-of-words features (X2) are columns beside them, and the stateless
    features are one projection over the tokenised table.  The label is carried when present (E9).
    """
    unknown = [f for f in features if f not in REGISTRY and f != "TFIDFSpanish"]
    if unknown:
        raise KeyError(f"unknown features: {unknown}")
    bag = "WordMatchShare" in features or "TFIDFSpanish" in features
    # word match share comes from the bag-of-words job (linear in text length) when it runs anyway
    cols = [c for f in features if f in REGISTRY and not (bag and f == "WordMatchShare") for c in REGISTRY[f].columns()]
    if "label" in pairs.columns:
        cols.append(label_column())
    if not bag:
        return tokenise(pairs, keys, lang).select(*keys, *cols)
    pairs = filled(pairs)
    tfidf = "TFIDFSpanish" in features
    # the texts of a key are one row for the bags, and rows of their own again for the other features
    held = ["s1", "s2", *(["label"] if "label" in pairs.columns else [])]
    grouped = pairs.groupBy(*keys).agg(F.collect_list(F.struct(*held)).alias("_rows"))
    grouped = grouped.select(*keys, "_rows", *[F.array_join(f"_rows.{s}", " ").alias(s) for s in ("s1", "s2")])
    b = _bags(grouped, keys, ["_rows"], _idf_of(pairs, idf) if tfidf else None, lang, null_keys=False)
    bags = [c for c in b.columns if c not in [*keys, "_rows"] and (c != "word_match_share" or "WordMatchShare" in features)]
    known = functools.reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])  # a row without a key has no bag
    rows = b.select(*keys, *[F.when(known, F.col(c)).alias(c) for c in bags], F.explode("_rows").alias("_row"))
    return tokenise(rows.select(*keys, *bags, "_row.*"), [*keys, *bags], lang).select(*keys, *cols, *bags)
