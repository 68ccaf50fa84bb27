"""Pair views and pair-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..session import cut_lineage
from ..sources import pairs as P
from . import sqlbits as S
from .catalog import query
from .views import CONV_PAIRS, DOC_PAIRS, LABELLED_DOC_PAIRS, SPLIT_DOC_PAIRS, with_views

CK = ["conv_id", "turn"]
CKS = "conv_id, turn"

# tokenised conversation pairs in DuckDB (mirror of features.tokenise)
TOK = f"""SELECT conv_id, turn, s1, s2,
  {S.tokens_ws('lower(s1)')} AS ws1, {S.tokens_ws('lower(s2)')} AS ws2,
  {S.tokens_word(f"lower({S.as_text('s1')})")} AS wt1, {S.tokens_word(f"lower({S.as_text('s2')})")} AS wt2
FROM cp"""
TOK_SW = f"""SELECT *, {S.remove_stopwords('ws1')} AS sw1, {S.remove_stopwords('ws2')} AS sw2 FROM tok0"""


def conv_sql(body: str) -> str:
    return with_views(body, cp=CONV_PAIRS, tok0=TOK, tok=TOK_SW)


@query("conv_pairs", with_views("SELECT * FROM cp", cp=CONV_PAIRS), ("FIXTURE conv_pairs",))
def conv_pairs(spark, sf):
    return P.conv_pairs(spark, sf)


@query("doc_pairs", DOC_PAIRS, ("FIXTURE doc_pairs", "W: previous in group"))
def doc_pairs(spark, sf):
    return P.doc_pairs(spark, sf)


@query("labelled_doc_pairs", LABELLED_DOC_PAIRS, ("FIXTURE is_duplicate",))
def labelled_doc_pairs(spark, sf):
    return P.labelled_doc_pairs(spark, sf)


WMS_SQL = f"{S.try_divide(f'{S.shared_count('sw1', 'sw2')} + {S.shared_count('sw2', 'sw1')}', 'len(sw1) + len(sw2)')}"
LEN_SQL = """CAST(length(s1) AS BIGINT) AS len_char1, CAST(length(s2) AS BIGINT) AS len_char2,
  CAST(len(ws1) AS BIGINT) AS len_word1, CAST(len(ws2) AS BIGINT) AS len_word2,
  CAST(abs(length(s1) - length(s2)) AS BIGINT) AS len_char_diff,
  CAST(abs(len(ws1) - len(ws2)) AS BIGINT) AS len_word_diff"""


@query("word_match_share", conv_sql(f"SELECT {CKS}, {WMS_SQL} AS word_match_share, {LEN_SQL} FROM tok"),
       ("E2", "E3", "P3", "P5", "F1", "D2", "I15"))
def word_match_share(spark, sf):
    """Flagship: conversation pairs -> E2 word match share + E3 lengths."""
    t = X.tokenise(P.conv_pairs(spark, sf), CK)
    return t.select(*CK, X.word_match_share(), *X.length_columns())


@query("word_match_share_docs",
       with_views(f"""SELECT pair_id, {S.try_divide(f'{S.shared_count('a', 'b')} + {S.shared_count('b', 'a')}', 'len(a) + len(b)')} AS word_match_share
FROM (SELECT pair_id, {S.remove_stopwords(S.tokens_ws('lower(s1)'))} AS a, {S.remove_stopwords(S.tokens_ws('lower(s2)'))} AS b FROM dp)""",
                  dp=DOC_PAIRS),
       ("E2", "D2 (exploded semi-join form)", "G1"))
def word_match_share_docs(spark, sf):
    """E2 over whole documents via the relational (exploded) form."""
    return X.word_match_share_exploded(P.doc_pairs(spark, sf), ["pair_id"])


NOT_SQL = f"""SELECT {CKS}, CAST(c1 AS BIGINT) AS not_cnt1, CAST(c2 AS BIGINT) AS not_cnt2,
  CASE WHEN c1 > 0 AND c2 > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_both,
  CASE WHEN c1 > 0 OR c2 > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_any,
  CASE WHEN (c2 <= 0 AND c1 > 0) OR (c1 <= 0 AND c2 > 0) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_one,
  CASE WHEN abs(c1 - c2) % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_same_parity
FROM (SELECT {CKS}, {S.count_in('wt1', ('no', 'ni', 'nunca'))} AS c1, {S.count_in('wt2', ('no', 'ni', 'nunca'))} AS c2 FROM tok)"""


@query("negation", conv_sql(NOT_SQL), ("E1", "P6", "P7"))
def negation(spark, sf):
    return X.negation_features(P.conv_pairs(spark, sf), CK)


JAC_SQL = ", ".join(f"{S.jaccard(S.ngrams('wt1', n), S.ngrams('wt2', n))} AS ngram_jaccard_{n}" for n in (1, 2, 3))


@query("ngram_jaccard", conv_sql(f"SELECT {CKS}, {JAC_SQL} FROM tok"), ("E4", "N1", "N2", "N3", "I7", "U3"))
def ngram_jaccard(spark, sf):
    return X.ngram_jaccard_features(P.conv_pairs(spark, sf), CK)


# LCS oracle: a recursive CTE over the rows of the DP, one step per token of s1.
LCS_SQL = f"""WITH RECURSIVE cp AS ({CONV_PAIRS}),
tok AS (SELECT {CKS}, {S.tokens_ws('lower(s1)')} AS a, {S.tokens_ws('lower(s2)')} AS b FROM cp),
dp(conv_id, turn, i, row, a, b) AS (
  SELECT conv_id, turn, 0, list_transform(range(0, len(b) + 1), lambda z: 0), a, b FROM tok
  UNION ALL
  SELECT conv_id, turn, i + 1,
    list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE greatest(row[j + 1],
      coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: b[k] = a[i + 1]),
                                       lambda k: row[k] + 1)), 0)) END),
    a, b
  FROM dp WHERE i < len(a))
SELECT {CKS}, {S.try_divide('row[len(b) + 1]', 'len(a) + len(b)')} AS lcs_ratio
FROM dp WHERE i = len(a)"""


@query("lcs_ratio", LCS_SQL, ("E5",))
def lcs_ratio(spark, sf):
    return X.lcs_features(P.conv_pairs(spark, sf), CK)


IDF_CTE = f"""n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cp),
sent AS (SELECT s1 AS s FROM cp UNION SELECT s2 FROM cp),
idf AS (SELECT word, log2((SELECT n FROM n) / (count(*) + 1.0)) AS idf
        FROM (SELECT unnest({S.tokens_ws('lower(s)')}) AS word FROM sent) GROUP BY word)"""

IDF_SQL = f"""WITH cp AS ({CONV_PAIRS}), {IDF_CTE}
SELECT word, round(idf, 6) AS idf FROM idf"""


@query("corpus_idf", IDF_SQL, ("G2", "U2"))
def corpus_idf(spark, sf):
    idf = X.corpus_idf(P.conv_pairs(spark, sf))
    return idf.select("word", F.round("idf", 6).alias("idf"))


TFIDF_COLS = ("tfidf_sum1", "tfidf_sum2", "tfidf_mean1", "tfidf_mean2", "tfidf_sum_diff", "tfidf_mean_diff")

TFIDF_SQL = f"""WITH cp AS ({CONV_PAIRS}), {IDF_CTE},
sides AS (SELECT {CKS}, 1 AS side, unnest({S.remove_stopwords(S.tokens_ws('lower(s1)'))}) AS word FROM cp
          UNION ALL
          SELECT {CKS}, 2 AS side, unnest({S.remove_stopwords(S.tokens_ws('lower(s2)'))}) AS word FROM cp),
tf AS (SELECT {CKS}, side, word, count(*) AS tf FROM sides GROUP BY ALL),
w AS (SELECT {CKS}, side, tf * coalesce(idf, 0.0) AS wt FROM tf LEFT JOIN idf USING (word)),
pp AS (SELECT {CKS}, sum(wt) FILTER (WHERE side = 1) AS s1_, sum(wt) FILTER (WHERE side = 2) AS s2_,
              count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2
       FROM w GROUP BY ALL),
f AS (SELECT cp.conv_id, cp.turn, coalesce(s1_, 0.0) AS a, coalesce(s2_, 0.0) AS b,
             {S.try_divide('coalesce(s1_, 0.0)', 'coalesce(n1, 0)')} AS ma,
             {S.try_divide('coalesce(s2_, 0.0)', 'coalesce(n2, 0)')} AS mb
      FROM cp LEFT JOIN pp ON cp.conv_id = pp.conv_id AND cp.turn = pp.turn)
SELECT {CKS}, round(a, 6) AS tfidf_sum1, round(b, 6) AS tfidf_sum2, round(ma, 6) AS tfidf_mean1,
  round(mb, 6) AS tfidf_mean2, round(abs(a - b), 6) AS tfidf_sum_diff, round(abs(ma - mb), 6) AS tfidf_mean_diff
FROM f"""


def _round_cols(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


@query("tfidf", TFIDF_SQL, ("E8", "G1", "G2", "G3", "D1", "D5", "X2"))
def tfidf(spark, sf):
    return _round_cols(X.tfidf_features(P.conv_pairs(spark, sf), CK), TFIDF_COLS)


PF_SQL = f"""WITH cp AS ({SPLIT_DOC_PAIRS.replace(chr(10), ' ')}),
tok0 AS ({TOK.replace('conv_id, turn', 'pair_id, label')}),
tok AS ({TOK_SW}),
{IDF_CTE},
sides AS (SELECT pair_id, 1 AS side, unnest({S.remove_stopwords(S.tokens_ws('lower(s1)'))}) AS word FROM cp
          UNION ALL
          SELECT pair_id, 2 AS side, unnest({S.remove_stopwords(S.tokens_ws('lower(s2)'))}) AS word FROM cp),
tf AS (SELECT pair_id, side, word, count(*) AS tf FROM sides GROUP BY ALL),
w AS (SELECT pair_id, side, tf * coalesce(idf, 0.0) AS wt FROM tf LEFT JOIN idf USING (word)),
pp AS (SELECT pair_id, sum(wt) FILTER (WHERE side = 1) AS s1_, sum(wt) FILTER (WHERE side = 2) AS s2_,
              count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2
       FROM w GROUP BY ALL),
tfidf AS (SELECT cp.pair_id, coalesce(s1_, 0.0) AS a, coalesce(s2_, 0.0) AS b,
             {S.try_divide('coalesce(s1_, 0.0)', 'coalesce(n1, 0)')} AS ma,
             {S.try_divide('coalesce(s2_, 0.0)', 'coalesce(n2, 0)')} AS mb
      FROM cp LEFT JOIN pp ON cp.pair_id = pp.pair_id),
st AS (SELECT pair_id, label, {S.count_in('wt1', ('no', 'ni', 'nunca'))} AS c1, {S.count_in('wt2', ('no', 'ni', 'nunca'))} AS c2,
  {WMS_SQL} AS word_match_share, {LEN_SQL}, {JAC_SQL}, ws1, ws2 FROM tok)
SELECT st.pair_id, CAST(c1 AS BIGINT) AS not_cnt1, CAST(c2 AS BIGINT) AS not_cnt2,
  CASE WHEN c1 > 0 AND c2 > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_both,
  CASE WHEN c1 > 0 OR c2 > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_any,
  CASE WHEN (c2 <= 0 AND c1 > 0) OR (c1 <= 0 AND c2 > 0) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_one,
  CASE WHEN abs(c1 - c2) % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS not_same_parity,
  word_match_share, len_char1, len_char2, len_word1, len_word2, len_char_diff, len_word_diff,
  ngram_jaccard_1, ngram_jaccard_2, ngram_jaccard_3, CAST(label AS INTEGER) AS label,
  round(a, 6) AS tfidf_sum1, round(b, 6) AS tfidf_sum2, round(ma, 6) AS tfidf_mean1,
  round(mb, 6) AS tfidf_mean2, round(abs(a - b), 6) AS tfidf_sum_diff, round(abs(ma - mb), 6) AS tfidf_mean_diff
FROM st JOIN tfidf ON st.pair_id = tfidf.pair_id"""


def split_pairs_and_idf(spark, sf):
    """The document pairs with label and split, and the idf of their words (G2) from texts that are not in pairs yet."""
    links = P.with_labels(P.doc_links(spark, sf), spark, sf)
    return P.split_doc_pairs(spark, sf, links), cut_lineage(X.sentence_idf(*P.linked_sentences(links, spark, sf)))


@query("pair_features", None, ("E10", "E1", "E2", "E3", "E4", "E5", "E8", "E9", "P9", "X1", "X3"))
def pair_features(spark, sf):
    """Every extractor on every whole-document pair; label -1 where a side is unlabelled.

    No SQL: the longest common subsequence of long texts is too slow there.  Its other columns are
    checked by ``pair_features_sql``, and it by a plain version in the tests.
    """
    pairs, idf = split_pairs_and_idf(spark, sf)
    return _round_cols(X.pair_features(pairs, ["pair_id"], idf=idf), TFIDF_COLS)


@query("pair_features_sql", PF_SQL, ("E10 without E5",))
def pair_features_sql(spark, sf):
    """The features of ``pair_features`` that SQL can express, on the same pairs."""
    feats = ("Not", "WordMatchShare", "Length", "NgramJaccardCoef", "TFIDFSpanish")
    pairs, idf = split_pairs_and_idf(spark, sf)
    return _round_cols(X.pair_features(pairs, ["pair_id"], feats, idf=idf), TFIDF_COLS)


# Turns whose texts are absent, empty, blank or punctuation alone, by conversation, on either side.
ODD = """SELECT conv_id, turn,
  CASE conv_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN '?!' ELSE s1 END AS s1,
  CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN s1 ELSE s2 END AS s2
FROM cp0"""
ODD_NULLS = "SELECT conv_id, turn, coalesce(s1, '') AS s1, coalesce(s2, '') AS s2 FROM cp1"


@query("odd_text_features",
       with_views(f"SELECT {CKS}, {WMS_SQL} AS word_match_share, {LEN_SQL}, {JAC_SQL}, "
                  f"CAST({S.count_in('wt1', ('no', 'ni', 'nunca'))} AS BIGINT) AS not_cnt1, CAST({S.count_in('wt2', ('no', 'ni', 'nunca'))} AS BIGINT) AS not_cnt2 FROM tok",
                  cp0=CONV_PAIRS, cp1=ODD, cp=ODD_NULLS, tok0=TOK, tok=TOK_SW), ("NULL and empty texts",))
def odd_text_features(spark, sf):
    """The stateless features where texts are absent, empty, blank or punctuation: no row is lost."""
    c = F.col("conv_id")
    s1 = F.when(c % 7 == 0, None).when(c % 7 == 1, "").when(c % 7 == 2, "   ").when(c % 7 == 3, "?!").otherwise(F.col("s1"))
    s2 = F.when(c % 5 == 0, None).when(c % 5 == 1, "").when(c % 5 == 2, F.col("s1")).otherwise(F.col("s2"))
    t = X.tokenise(P.conv_pairs(spark, sf).select(*CK, s1.alias("s1"), s2.alias("s2")), CK)
    return t.select(*CK, X.word_match_share(), *X.length_columns(), *X.ngram_jaccard_columns(), *X.negation_columns()[:2])
