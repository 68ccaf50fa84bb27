"""Text, n-gram, distance and maths queries (P, F, N, I) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import grams as G
from ..functions import text as T
from ..sources.tables import table
from . import sqlbits as S
from .catalog import query


@query("text_clean", f"""SELECT doc_id, {S.strip_punct_paired('text')} AS paired, {S.strip_punct_all('text')} AS no_punct,
  lower(text) AS lowered, {S.as_text('text')} AS stripped FROM documents""", ("P1", "P2", "P3", "P7"))
def text_clean(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", T.strip_punct_paired("text").alias("paired"),
                    T.strip_punct_all("text").alias("no_punct"), T.lower("text").alias("lowered"),
                    T.as_text("text").alias("stripped"))


@query("tokens", f"""SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_ws, CAST(len(wt) AS BIGINT) AS n_word,
  array_to_string(ws, ' ') AS ws_text, array_to_string(wt, '|') AS word_text
FROM (SELECT doc_id, {S.tokens_ws('lower(text)')} AS ws, {S.tokens_word('lower(text)')} AS wt FROM documents)""",
       ("P5", "P6"))
def tokens(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    t = d.select("doc_id", T.tokens_ws(T.lower("text")).alias("ws"), T.tokens_word(T.lower("text")).alias("wt"))
    return t.select("doc_id", F.size("ws").cast("long").alias("n_ws"), F.size("wt").cast("long").alias("n_word"),
                    F.array_join("ws", " ").alias("ws_text"), F.array_join("wt", "|").alias("word_text"))


@query("stopwords", f"""SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_tok, CAST(len(f1) AS BIGINT) AS n_f1,
  CAST(len(f2) AS BIGINT) AS n_f2, array_to_string(f1, ' ') AS f1_text, array_to_string(f2, ' ') AS f2_text
FROM (SELECT conv_id, turn, w, {S.remove_stopwords('w')} AS f1, {S.content_words('w')} AS f2
      FROM (SELECT conv_id, turn, {S.tokens_ws('lower(text)')} AS w FROM conversations))""", ("F1", "F2", "D5"))
def stopwords(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    t = c.select("conv_id", "turn", T.tokens_ws(T.lower("text")).alias("w"))
    t = t.select("conv_id", "turn", "w", T.remove_stopwords("w").alias("f1"), T.content_words("w").alias("f2"))
    return t.select("conv_id", "turn", F.size("w").cast("long").alias("n_tok"),
                    F.size("f1").cast("long").alias("n_f1"), F.size("f2").cast("long").alias("n_f2"),
                    F.array_join("f1", " ").alias("f1_text"), F.array_join("f2", " ").alias("f2_text"))


NGRAM_SPECS = [("g1", 1), ("g2", 2), ("g3", 3), ("g4", 4), ("g12", 12), ("g123", 123)]


def _ngram_sql():
    parts = []
    for name, n in NGRAM_SPECS:
        g = S.ngrams("w", n, "_")
        parts.append(f"CAST(len({g}) AS BIGINT) AS n_{name}, array_to_string({g}, '|') AS {name}")
    for name, fn in (("b_skip1", S.bigrams_skip("w", "_", 1)), ("t_skip1", S.trigrams_skip("w", "_", 1))):
        parts.append(f"CAST(len({fn}) AS BIGINT) AS n_{name}, array_to_string({fn}, '|') AS {name}")
    return ",\n  ".join(parts)


@query("ngrams", f"""SELECT conv_id, turn, {_ngram_sql()}
FROM (SELECT conv_id, turn, {S.tokens_ws('lower(text)')} AS w FROM conversations)""",
       ("N1", "N2", "N3", "N4", "N8", "F5"))
def ngrams(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    t = c.select("conv_id", "turn", T.tokens_ws(T.lower("text")).alias("w"))
    cols = []
    for name, n in NGRAM_SPECS:
        g = G.ngrams("w", n, "_")
        cols += [F.size(g).cast("long").alias(f"n_{name}"), F.array_join(g, "|").alias(name)]
    for name, g in (("b_skip1", G.bigrams("w", "_", 1)), ("t_skip1", G.trigrams("w", "_", 1))):
        cols += [F.size(g).cast("long").alias(f"n_{name}"), F.array_join(g, "|").alias(name)]
    return t.select("conv_id", "turn", *cols)


def _nterm_sql():
    parts = []
    for n, fn in ((1, "w"), (2, S.biterms("w", "_")), (3, S.triterms("w", "_")), (4, S.fourterms("w", "_"))):
        parts.append(f"CAST(len({fn}) AS BIGINT) AS n_t{n}, array_to_string({fn}, '|') AS t{n}")
    return ",\n  ".join(parts)


@query("nterms", f"""SELECT p_partkey, {_nterm_sql()}
FROM (SELECT p_partkey, {S.tokens_ws("lower(p_name || ' ' || p_type || ' ' || p_brand)")} AS w FROM part)""",
       ("N5", "N6", "N7", "N9"))
def nterms(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand")
    t = p.select("p_partkey", T.tokens_ws(T.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("w"))
    cols = []
    for n in (1, 2, 3, 4):
        g = G.nterms("w", n, "_")
        cols += [F.size(g).cast("long").alias(f"n_t{n}"), F.array_join(g, "|").alias(f"t{n}")]
    return t.select("p_partkey", *cols)


DIST_SQL = f"""SELECT p_partkey,
  {S.edit_dist('a', 'b')} AS edit_dist,
  (a = b) AS match_exact,
  (1.0 - {S.edit_dist('a', 'b')}) >= 0.3 AS match_03,
  {S.jaccard(S.tokens_ws('a'), S.tokens_ws('b'))} AS jaccard_words,
  {S.dice(S.chars('a'), S.chars('b'))} AS dice_chars,
  {S.try_divide(f"len(list_intersect({S.plain_grams(S.chars('a'), 2)}, {S.plain_grams(S.chars('b'), 2)}))",
                f"len({S.plain_grams(S.chars('a'), 2)}) + len({S.plain_grams(S.chars('b'), 2)})")} AS overlap_2,
  {S.try_divide(f"len(list_intersect({S.plain_grams(S.chars('a'), 3)}, {S.plain_grams(S.chars('b'), 3)}))",
                f"len({S.plain_grams(S.chars('a'), 3)}) + len({S.plain_grams(S.chars('b'), 3)})")} AS overlap_3,
  CAST(bit_count(CAST(p_size AS BIGINT)) AS INTEGER) AS size_bits,
  CASE WHEN p_partkey = 0 THEN '' ELSE bin(p_partkey) END AS key_binary,
  {S.try_divide('p_retailprice', 'p_size - 25')} AS price_per_size,
  CAST(length(a) AS BIGINT) AS len_a
FROM (SELECT p_partkey, p_size, p_retailprice, lower(p_name) AS a, lower(p_type) AS b FROM part)"""


@query("string_distances", DIST_SQL, ("I1", "I2", "I5", "I7", "I8", "I10", "I11", "I15", "F6", "U3"))
def string_distances(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    p = p.select("p_partkey", "p_size", "p_retailprice", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    p = p.withColumn("ca", T.chars("a")).withColumn("cb", T.chars("b"))
    ca, cb = F.col("ca"), F.col("cb")
    return p.select(
        "p_partkey", D.edit_dist("a", "b").alias("edit_dist"),
        D.is_str_match("a", "b", 1.0).alias("match_exact"), D.is_str_match("a", "b", 0.3).alias("match_03"),
        D.jaccard(T.tokens_ws("a"), T.tokens_ws("b")).alias("jaccard_words"),
        D.dice(ca, cb).alias("dice_chars"),
        D.n_gram_overlap(ca, cb, 2).alias("overlap_2"), D.n_gram_overlap(ca, cb, 3).alias("overlap_3"),
        D.count_one_bits("p_size").alias("size_bits"), D.int_to_binary("p_partkey").alias("key_binary"),
        D.try_divide("p_retailprice", F.col("p_size") - 25).alias("price_per_size"),
        D.char_length("a").cast("long").alias("len_a"))


MATH_SQL = """SELECT event_id, p_cut, round(ln(p_cut / (1.0 - p_cut)), 9) AS logit_p,
  round(1.0 / (1.0 + exp(-(value / 100.0))), 9) AS logistic_v,
  NOT (isnan(x) OR isinf(x)) AS finite_x, round_even(value / 7.0, 4) AS value_r4
FROM (SELECT event_id, value, sqrt(value - 100.0) AS x,
        least(greatest((event_id % 97 + 1) / 98.0, 1e-15), 1.0 - 1e-15) AS p_cut FROM events)"""


@query("math_functions", MATH_SQL, ("I12", "I13", "I14", "I16", "F4"))
def math_functions(spark, sf):
    e = table(spark, sf, "events", "event_id", "value")
    p = (F.col("event_id") % 97 + 1) / 98.0
    return e.select("event_id", D.cut_prob(p).alias("p_cut"), F.round(D.logit(p), 9).alias("logit_p"),
                    F.round(D.logistic(F.col("value") / 100.0), 9).alias("logistic_v"),
                    T.is_finite(F.sqrt(F.col("value") - 100.0)).alias("finite_x"),
                    D.round4(F.col("value") / 7.0).alias("value_r4"))


COS_SQL = """SELECT b.vec_id, round(CASE WHEN na * nb = 0 THEN 0.0 ELSE d / (na * nb) END, 6) AS cosine
FROM (SELECT b.vec_id,
        list_reduce(list_transform(list_zip(a.e, b.e), lambda t: t[1] * t[2]), lambda x, y: x + y, 0.0) AS d,
        sqrt(list_reduce(list_transform(a.e, lambda x: x * x), lambda x, y: x + y, 0.0)) AS na,
        sqrt(list_reduce(list_transform(b.e, lambda x: x * x), lambda x, y: x + y, 0.0)) AS nb
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a
      JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1) b"""


@query("cosine_neighbours", COS_SQL, ("I9",))
def cosine_neighbours(spark, sf):
    """I9 between each embedding and the one with the previous id (equi-join on id + 1)."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    a = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("ea"))
    return (a.join(e, "vec_id").select("vec_id", F.round(D.cosine_sim("ea", "embedding"), 6).alias("cosine")))
