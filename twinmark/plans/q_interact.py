"""Token-interaction and stacking queries (M1-M10) over document-pair id sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import corpus as C
from ..operators import features as X
from ..operators import interact as I
from ..operators import stacking as SK
from ..session import cut_lineage
from ..sources import pairs as P
from ..sources.tables import table
from .catalog import query
from .q_corpus import BASE, KEYS, prepared, sequences_of
from .q_features import split_pairs_and_idf

DIM = 64
R = 6

# DuckDB: sequences, embedding table, token vectors (last 30 ids) and cells
IBASE = BASE + """,
ex2 AS (SELECT pair_id, side, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM f3),
ids AS (SELECT ex2.pair_id, ex2.side, list(CAST(v.idx AS INTEGER) ORDER BY ex2.pos) AS ids
        FROM ex2 JOIN vocab v ON v.word = ex2.word WHERE v.idx < 20000 GROUP BY ex2.pair_id, ex2.side),
seq AS (SELECT f3.pair_id, f3.side, coalesce(ids.ids, []::INTEGER[]) AS ids
        FROM f3 LEFT JOIN ids ON ids.pair_id = f3.pair_id AND ids.side = f3.side),
embt AS (SELECT CAST(v.idx AS INTEGER) AS idx, CAST(coalesce(wv.vec, list_transform(range(64), lambda z: CAST(0.0 AS FLOAT))) AS DOUBLE[]) AS vec
         FROM vocab v LEFT JOIN wv ON wv.word = v.word WHERE v.idx < 20000
         UNION ALL SELECT 0, list_transform(range(64), lambda z: 0.0)),
tails AS (SELECT pair_id, side, list_slice(ids, greatest(len(ids) - 30 + 1, 1), len(ids)) AS t FROM seq),
tv AS (SELECT x.pair_id, x.side, x.pos - 1 AS pos, e.vec FROM
         (SELECT pair_id, side, unnest(t) AS idx, generate_subscripts(t, 1) AS pos FROM tails) x JOIN embt e ON e.idx = x.idx),
lens AS (SELECT pair_id, max(CASE WHEN side = 1 THEN len(t) END) AS n1, max(CASE WHEN side = 2 THEN len(t) END) AS n2
         FROM tails GROUP BY pair_id),
tvn AS (SELECT *, sqrt(list_reduce(list_transform(vec, lambda x: x * x), lambda x, y: x + y, 0.0)) AS nrm FROM tv),
cells AS (SELECT a.pair_id, a.pos AS i, b.pos AS j, a.vec AS v1, b.vec AS v2, a.nrm AS n1, b.nrm AS n2
          FROM tvn a JOIN tvn b ON a.pair_id = b.pair_id AND a.side = 1 AND b.side = 2)"""

DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2]), lambda x, y: x + y, 0.0)"
NORM = "sqrt(list_reduce(list_transform({a}, lambda x: x * x), lambda x, y: x + y, 0.0))"
UNIT = f"list_transform({{a}}, lambda x: CASE WHEN {NORM} > 0 THEN x / {NORM} ELSE 0.0 END)"
SUM = "list_reduce({a}, lambda x, y: x + y, 0.0)"


def _dot(a, b):
    return DOT.format(a=a, b=b)


def _unit(a):
    return UNIT.format(a=a)


def _sum(a):
    return SUM.format(a=a)


def _prep(spark, sf):
    links, vectors, tokens, vocab = prepared(spark, sf)
    return sequences_of(links, tokens, vocab, C.MAX_SEQUENCE_LENGTH), C.embedding_table(vocab, vectors, DIM)


def _matrix(spark, sf):
    """One row per pair with its score matrix."""
    seqs, emb = _prep(spark, sf)
    return I.score_matrix(I.side_vectors(seqs, KEYS, emb), KEYS)


@query("match_matrix", f"""WITH {IBASE}
SELECT pair_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round({_dot('v1', 'v2')}, {R}) AS dot,
       round(coalesce({_dot('v1', 'v2')} / nullif(n1 * n2, 0.0), 0.0), {R}) AS cosine FROM cells""", ("M1", "D6", "D3", "I9"))
def match_matrix(spark, sf):
    rows = _matrix(spark, sf).select(*KEYS, "k1", "k2", F.posexplode("m").alias("i", "_r")).select(
        *KEYS, "i", "k1", "k2", F.posexplode("_r").alias("j", "dot"))
    cosine = D.try_divide("dot", F.get("k1", F.col("i")) * F.get("k2", F.col("j")))
    return rows.select(*KEYS, "i", "j", F.round("dot", R).alias("dot"), F.round(cosine, R).alias("cosine"))


@query("match_elementwise", f"""WITH {IBASE}
SELECT pair_id, round(sum({_sum('list_transform(list_zip(v1, v2), lambda t: t[1] * t[2])')}), 4) AS mul_sum,
       round(sum({_sum('list_transform(list_zip(v1, v2), lambda t: t[1] + t[2])')}), 4) AS plus_sum,
       round(sum({_sum('list_transform(list_zip(v1, v2), lambda t: t[1] - t[2])')}), 4) AS minus_sum,
       CAST(sum(len(list_concat(v1, v2))) AS BIGINT) AS concat_len
FROM cells GROUP BY pair_id""", ("M2", "M3"))
def match_elementwise(spark, sf):
    """All kinds of a cell in one pass; the sums are taken in the pair's row."""
    seqs, emb = _prep(spark, sf)
    rows = I.elementwise_sums(I.side_vectors(seqs, KEYS, emb), KEYS)
    return rows.select(*KEYS, *[F.round(k, 4).alias(f"{k}_sum") for k in ("mul", "plus", "minus")], F.col("concat").alias("concat_len"))


TOPK_SQL = f"""WITH {IBASE},
sc AS (SELECT pair_id, list({_dot('v1', 'v2')}) AS s FROM cells GROUP BY pair_id),
full_ AS (SELECT l.pair_id, list_concat(coalesce(sc.s, []::DOUBLE[]),
            list_transform(range(900 - coalesce(l.n1, 0) * coalesce(l.n2, 0)), lambda z: 0.0)) AS a
          FROM lens l LEFT JOIN sc ON sc.pair_id = l.pair_id),
tk AS (SELECT pair_id, list_slice(list_sort(a, 'DESC'), 1, 100) AS t FROM full_)
SELECT pair_id, round({_sum('t')}, 5) AS topk_sum, round(list_min(t), {R}) AS topk_min,
       round(list_max(t), {R}) AS topk_max, CAST(len(t) AS BIGINT) AS topk_n FROM tk"""


@query("topk_cells", TOPK_SQL, ("M4", "W3"))
def topk_cells(spark, sf):
    t = I.matrix_topk(_matrix(spark, sf), KEYS, 100)
    return t.select(*KEYS, F.round(I.vec_sum("topk"), 5).alias("topk_sum"),
                    F.round(F.array_min("topk"), R).alias("topk_min"), F.round(F.array_max("topk"), R).alias("topk_max"),
                    F.size("topk").cast("long").alias("topk_n"))


POOL_SQL = f"""WITH {IBASE},
sc AS (SELECT pair_id, i, j, {_dot('v1', 'v2')} AS score FROM cells),
g AS (SELECT unnest(range(30)) AS gi),
rws AS (SELECT DISTINCT l.pair_id, CAST(g.gi // 6 AS INTEGER) AS bi,
          CASE WHEN l.n1 > 0 THEN CAST(floor(g.gi / (30.0 / l.n1)) AS INTEGER) END AS i FROM lens l, g),
cls AS (SELECT DISTINCT l.pair_id, CAST(g.gi // 6 AS INTEGER) AS bj,
          CASE WHEN l.n2 > 0 THEN CAST(floor(g.gi / (30.0 / l.n2)) AS INTEGER) END AS j FROM lens l, g)
SELECT r.pair_id, r.bi, c.bj, round(max(coalesce(sc.score, 0.0)), {R}) AS pooled
FROM rws r JOIN cls c ON c.pair_id = r.pair_id
LEFT JOIN sc ON sc.pair_id = r.pair_id AND sc.i = r.i AND sc.j = c.j
GROUP BY r.pair_id, r.bi, c.bj"""


@query("dynamic_pooling", POOL_SQL, ("M5",))
def dynamic_pooling(spark, sf):
    p = I.matrix_pool(_matrix(spark, sf), KEYS, 5, 5)
    return p.select(*KEYS, F.col("bi").cast("int"), F.col("bj").cast("int"), F.round("pooled", R).alias("pooled"))


ALIGN_SQL = f"""WITH {IBASE},
sc AS (SELECT pair_id, i, j, {_dot('v1', 'v2')} AS score FROM cells),
dirs AS (SELECT pair_id, 1 AS side, i AS pos, j AS opos, score FROM sc UNION ALL SELECT pair_id, 2, j, i, score FROM sc),
w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY pair_id, side, pos)) AS e FROM dirs),
z AS (SELECT pair_id, side, pos, sum(e) AS z FROM w GROUP BY ALL),
ov AS (SELECT pair_id, side, pos AS opos, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM tv),
num AS (SELECT w.pair_id, w.side, w.pos, ov.d, sum(w.e * ov.x) AS n FROM w JOIN ov
          ON ov.pair_id = w.pair_id AND ov.side = 3 - w.side AND ov.opos = w.opos GROUP BY ALL)
SELECT num.pair_id, num.side, CAST(num.pos AS INTEGER) AS pos, round(sum(n / z.z), 4) AS aligned_sum,
       CAST(count(*) AS BIGINT) AS dims
FROM num JOIN z ON z.pair_id = num.pair_id AND z.side = num.side AND z.pos = num.pos
GROUP BY num.pair_id, num.side, num.pos"""


@query("soft_align", ALIGN_SQL, ("M6",))
def soft_align(spark, sf):
    a = I.matrix_align(_matrix(spark, sf), KEYS)
    return a.select(*KEYS, F.col("side").cast("int"), F.col("pos").cast("int"),
                    F.round(I.vec_sum("aligned"), 4).alias("aligned_sum"), F.size("aligned").cast("long").alias("dims"))


SENT_SQL = f"""WITH {IBASE},
padded AS (SELECT pair_id, side, CASE WHEN len(ids) = 0 THEN list_transform(range(30), lambda z: 0)
             ELSE list_concat(list_transform(range(30 - least(30, len(ids))), lambda z: 0),
                              list_slice(ids, len(ids) - least(30, len(ids)) + 1, len(ids))) END AS p FROM seq),
ptv AS (SELECT x.pair_id, x.side, e.vec FROM (SELECT pair_id, side, unnest(p) AS idx FROM padded) x JOIN embt e ON e.idx = x.idx),
vex AS (SELECT pair_id, side, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM ptv),
agg AS (SELECT pair_id, side, d, avg(x) AS mean, max(x) AS mx, sum(x) AS sm FROM vex GROUP BY ALL),
sv AS (SELECT pair_id, side, list(mean ORDER BY d) AS mean, list(mx ORDER BY d) AS mx, list(sm ORDER BY d) AS sm FROM agg GROUP BY ALL),
pv AS (SELECT a.pair_id, list_transform(list_zip(a.mean, b.mean), lambda t: abs(t[1] - t[2])) AS ad,
              list_transform(list_zip(a.mean, b.mean), lambda t: t[1] * t[2]) AS pr, list_concat(a.mean, b.mean) AS cc
       FROM sv a JOIN sv b ON a.pair_id = b.pair_id AND a.side = 1 AND b.side = 2)
SELECT sv.pair_id, sv.side, round({_sum('sv.mean')}, 5) AS mean_sum, round({_sum('sv.mx')}, 5) AS max_sum,
       round({_sum('sv.sm')}, 4) AS sum_sum, round({_sum('pv.ad')}, 5) AS absdiff_sum, round({_sum('pv.pr')}, 5) AS product_sum,
       CAST(len(pv.cc) AS BIGINT) AS concat_len
FROM sv JOIN pv ON pv.pair_id = sv.pair_id"""


@query("sentence_vectors", SENT_SQL, ("M7", "M8"))
def sentence_vectors(spark, sf):
    """A pair's two sides stay in one row until their sums are taken."""
    seqs, emb = _prep(spark, sf)
    sv = I.sentence_sides(I.side_vectors(seqs, KEYS, emb, padded=True), KEYS)
    pv = I.pair_vectors(sv, KEYS, "mean")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), *[F.round(I.vec_sum(f"s{i}.{kind}"), r).alias(f"{kind}_sum") for kind, r in (("mean", 5), ("max", 5), ("sum", 4))])
                      for i in (1, 2)])
    rows = pv.select(*KEYS, F.explode(sides).alias("_s"), F.round(I.vec_sum("abs_diff"), 5).alias("absdiff_sum"),
                     F.round(I.vec_sum("product"), 5).alias("product_sum"), F.size("concat").cast("long").alias("concat_len"))
    return rows.select(*KEYS, "_s.*", "absdiff_sum", "product_sum", "concat_len")


OOF_FEATURES = ["word_match_share", "len_word_diff", "len_char_diff", "ngram_jaccard_1", "ngram_jaccard_2",
                "not_same_parity", "tfidf_sum_diff", "tfidf_mean_diff"]


def _oof(spark, sf):
    pairs, idf = split_pairs_and_idf(spark, sf)
    feats = X.pair_features(pairs.drop("label"), ["pair_id"],
                            ("Not", "WordMatchShare", "Length", "NgramJaccardCoef", "TFIDFSpanish"), idf=idf)
    # stored: the training rows and the others are read apart
    feats = cut_lineage(feats).join(pairs.select("pair_id", "split", "label"), "pair_id")
    return SK.out_of_fold_scores(feats.where(F.col("split") == "train"), feats.where(F.col("split") == "test"),
                                 "pair_id", OOF_FEATURES, "label")


@query("oof_scores", None, ("M10", "M9", "G9", "W2", "S13 (scores)"))
def oof_scores(spark, sf):
    """Out-of-fold logistic-regression scores: one per labelled pair, fold-mean for the rest.
    Iterative model fitting: no SQL oracle (rows-only check; range and count tested in tests/)."""
    return _oof(spark, sf)


@query("assembled_features", None, ("M9",))
def assembled_features(spark, sf):
    """M9: the selected feature columns of every document pair as one vector (shown as its size
    and sum)."""
    from pyspark.ml.functions import vector_to_array
    pairs = P.split_doc_pairs(spark, sf)
    feats = X.pair_features(pairs.drop("label"), ["pair_id"], ("WordMatchShare", "Length", "NgramJaccardCoef"))
    cols = ["word_match_share", "len_char1", "len_char2", "len_word1", "len_word2", "ngram_jaccard_1"]
    a = SK.assemble(feats, cols)
    arr = vector_to_array("features")
    return a.select("pair_id", F.size(arr).cast("long").alias("n_features"),
                    F.round(I.vec_sum(arr), 6).alias("feature_sum"))


#: Dimensions of a block.
BLOCK = 16
BLOCKED_SQL = """SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


@query("blocked_dots", BLOCKED_SQL, ("M1 (large d)",))
def blocked_dots(spark, sf):
    """M1 by blocks of dimensions: each embedding with the next one, no row holding more than one block."""
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    cut = cut_lineage(I.blocks(v, "vec_id", "embedding", BLOCK))
    ids = v.select(F.col("vec_id").alias("a"))
    pairs = ids.join(ids.select((F.col("a") - 1).alias("a")), "a").select("a", (F.col("a") + 1).alias("b"))
    return I.blocked_dots(pairs, cut, cut, "a", "b", "vec_id").select("a", "b", F.round("dot", 6).alias("dot"))
