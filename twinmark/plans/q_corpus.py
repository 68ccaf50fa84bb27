"""Sequence preparation queries (K1-K5, G7, G8, F2, F3, W1, T1) over document pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..sources import pairs as P
from ..sources.tables import table
from . import sqlbits as S
from .catalog import query
from .views import DOC_PAIRS

KEYS = ["pair_id"]

SPLIT_PAIRS = f"""SELECT dp.*, CASE WHEN l1.quality IS NOT NULL AND l2.quality IS NOT NULL
    THEN CAST(l1.quality = l2.quality AS INTEGER) ELSE -1 END AS label,
  CASE WHEN l1.quality IS NOT NULL AND l2.quality IS NOT NULL THEN 'train' ELSE 'test' END AS split
FROM ({DOC_PAIRS}) dp LEFT JOIN labels l1 ON l1.doc_id = dp.prev_id LEFT JOIN labels l2 ON l2.doc_id = dp.pair_id"""

BASE = f"""dp AS ({SPLIT_PAIRS}),
wr AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS idx
       FROM (SELECT unnest({S.tokens_ws('lower(text)')}) AS word FROM documents) GROUP BY word),
wv AS (SELECT wr.word, e.embedding AS vec FROM wr JOIN embeddings e ON e.vec_id = wr.idx - 1),
sides AS (SELECT pair_id, 1 AS side, {S.content_words(S.tokens_ws('lower(s1)'))} AS toks FROM dp
          UNION ALL SELECT pair_id, 2 AS side, {S.content_words(S.tokens_ws('lower(s2)'))} AS toks FROM dp),
ex AS (SELECT pair_id, side, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM sides),
kept AS (SELECT pair_id, side, list(word ORDER BY pos) AS toks
         FROM ex WHERE word IN (SELECT word FROM wv) GROUP BY pair_id, side),
f3 AS (SELECT s.pair_id, s.side, coalesce(k.toks, []::VARCHAR[]) AS toks
       FROM sides s LEFT JOIN kept k ON k.pair_id = s.pair_id AND k.side = s.side),
vocab AS (SELECT word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, word) AS idx
          FROM (SELECT unnest(toks) AS word FROM f3) GROUP BY word)"""


def prepared(spark, sf):
    """Links with labels, word vectors, the documents' tokens, and the vocabulary over the links' sides."""
    links = P.with_labels(P.doc_links(spark, sf), spark, sf)
    vectors = P.word_vectors(spark, sf)
    tokens = C.document_tokens(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")
    ends = links.select(F.explode(F.array("prev_id", "pair_id")).alias("doc_id"))
    vocab = C.document_vocabulary(tokens, "doc_id", ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("w")), vectors)
    return links, vectors, tokens, vocab


def sequences_of(links, tokens, vocab, last=None):
    """(pair_id, side, ids): sequences are made once for each document and then paired; with ``last`` so many ids at their ends."""
    seqs = C.document_sequences(tokens, "doc_id", vocab, last=last)
    return C.pair_sides(links, KEYS, seqs, "doc_id")


@query("word_vectors", f"""WITH {BASE}
SELECT word, round(list_reduce(list_transform(vec, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0), 6) AS vec_sum FROM wv""",
       ("S6 (vector table)", "W1"))
def word_vectors(spark, sf):
    v = P.word_vectors(spark, sf)
    return v.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vec_sum"))


@query("vocabulary", f"WITH {BASE}\nSELECT word, CAST(n AS BIGINT) AS n, CAST(idx AS BIGINT) AS idx FROM vocab",
       ("K1", "G7", "W1", "F2", "F3"))
def vocabulary(spark, sf):
    return prepared(spark, sf)[-1].select("word", F.col("n").cast("long"), F.col("idx").cast("long"))


SEQ_SQL = f"""WITH {BASE},
ex2 AS (SELECT pair_id, side, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM f3),
ids AS (SELECT ex2.pair_id, ex2.side, list(CAST(v.idx AS INTEGER) ORDER BY ex2.pos) AS ids
        FROM ex2 JOIN vocab v ON v.word = ex2.word WHERE v.idx < 20000 GROUP BY ex2.pair_id, ex2.side),
seq AS (SELECT f3.pair_id, f3.side, coalesce(ids.ids, []::INTEGER[]) AS ids
        FROM f3 LEFT JOIN ids ON ids.pair_id = f3.pair_id AND ids.side = f3.side),
padded AS (SELECT pair_id, side, ids,
  CASE WHEN len(ids) = 0 THEN list_transform(range(30), lambda z: 0)
       ELSE list_concat(list_transform(range(30 - least(30, len(ids))), lambda z: 0),
                        list_slice(ids, len(ids) - least(30, len(ids)) + 1, len(ids))) END AS padded FROM seq)
SELECT p.pair_id, p.side, dp.split, CAST(dp.label AS INTEGER) AS label, array_to_string(ids, ' ') AS ids_text,
       array_to_string(padded, ' ') AS padded_text, CAST(len(ids) AS BIGINT) AS n_ids
FROM padded p JOIN dp ON dp.pair_id = p.pair_id"""


@query("sequences", SEQ_SQL, ("K2", "K3", "K5", "T1", "F2", "F3", "D3", "S4 (test rows)"))
def sequences(spark, sf):
    links, _, tokens, vocab = prepared(spark, sf)
    out = sequences_of(links, tokens, vocab).join(links.select("pair_id", "split", "label"), "pair_id")
    return out.select("pair_id", "side", "split", F.col("label").cast("int"),
                      F.array_join("ids", " ").alias("ids_text"),
                      F.array_join(C.pad("ids"), " ").alias("padded_text"),
                      F.size("ids").cast("long").alias("n_ids"))


EMB_SQL = f"""WITH {BASE},
body AS (SELECT CAST(v.idx AS BIGINT) AS idx, wv.vec IS NOT NULL AS has_vec,
  round(coalesce(list_reduce(list_transform(wv.vec, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0), 0.0), 6) AS vec_sum
  FROM vocab v LEFT JOIN wv ON wv.word = v.word WHERE v.idx <= 20000)
SELECT CAST(0 AS BIGINT) AS idx, false AS has_vec, 0.0 AS vec_sum UNION ALL SELECT * FROM body"""


def _emb(spark, sf):
    _, vectors, _, vocab = prepared(spark, sf)
    dim = 64
    return vocab, vectors, C.embedding_table(vocab, vectors, dim)


@query("embedding_table", EMB_SQL, ("K4", "D3"))
def embedding_table(spark, sf):
    _, _, emb = _emb(spark, sf)
    return emb.select(F.col("idx").cast("long"), "has_vec",
                      F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vec_sum"))


COV_SQL = f"""WITH {BASE}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM vocab WHERE word NOT IN (SELECT word FROM wv)) AS words_without_vector,
       (SELECT CAST(1 + count(*) FILTER (WHERE wv.word IS NULL OR list_reduce(list_transform(wv.vec, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0) = 0) AS BIGINT)
        FROM vocab v LEFT JOIN wv ON wv.word = v.word WHERE v.idx <= 20000) AS zero_rows"""


@query("vocab_coverage", COV_SQL, ("G8",))
def vocab_coverage(spark, sf):
    vocab, vectors, emb = _emb(spark, sf)
    return C.coverage(vocab, vectors, emb).select(F.col("words_without_vector").cast("long"),
                                                  F.col("zero_rows").cast("long"))
