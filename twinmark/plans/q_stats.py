"""Aggregates, correlation, balancing, folds, score evaluation and feature-matrix stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import sampling as SM
from ..operators import stats as ST
from ..sources import pairs as P
from ..sources.tables import table
from .catalog import query
from .q_features import CONV_PAIRS, TOK, TOK_SW, WMS_SQL
from .views import with_views
from . import sqlbits as S

AGG_SQL = """SELECT event_type, CAST(count(value) AS BIGINT) AS value_size, round(avg(value), 6) AS value_mean,
  round(stddev_pop(value), 6) AS value_std, max(value) AS value_max, min(value) AS value_min,
  median(value) AS value_median
FROM events GROUP BY event_type"""


@query("aggregate_modes", AGG_SQL, ("G4",))
def aggregate_modes(spark, sf):
    e = table(spark, sf, "events", "event_type", "value")
    out = ST.aggregate(e, "value", ["size", "MEAN", "std", "max", "min", "median"], by=["event_type"])
    return out.select("event_type", F.col("value_size").cast("long").alias("value_size"),
                      F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"),
                      "value_max", "value_min", "value_median")


QUANTILES = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
QUANTILE_SQL = f"""SELECT source, {', '.join(f'round(quantile_cont(CAST(n_chars AS DOUBLE), {q}), 6) AS q{i}' for i, q in enumerate(QUANTILES))}
FROM documents GROUP BY source"""


@query("length_quantiles", QUANTILE_SQL, ("G4 (quantiles)",))
def length_quantiles(spark, sf):
    """Exact quantiles of the texts' lengths by source, selected by rank; one source holds a third of them."""
    out = ST.exact_quantiles(table(spark, sf, "documents", "source", "n_chars"), "n_chars", list(QUANTILES), ["source"])
    return out.select("source", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(len(QUANTILES))])


CORR_SQL = """SELECT round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0.0), 0.0), 6) AS corr_chars,
  round(coalesce(covar_pop(t, y) / nullif(stddev_pop(t) * stddev_pop(y), 0.0), 0.0), 6) AS corr_toxic,
  round(coalesce(covar_pop(c, y) / nullif(stddev_pop(c) * stddev_pop(y), 0.0), 0.0), 6) AS corr_const
FROM (SELECT CAST(d.n_chars AS DOUBLE) AS x, CAST(l.toxic AS DOUBLE) AS t, 1.0 AS c, CAST(l.quality AS DOUBLE) AS y
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query("label_correlation", CORR_SQL, ("G5",))
def label_correlation(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.agg(F.round(ST.corr_with_label("n_chars", "quality"), 6).alias("corr_chars"),
                 F.round(ST.corr_with_label("toxic", "quality"), 6).alias("corr_toxic"),
                 F.round(ST.corr_with_label(F.lit(1.0), "quality"), 6).alias("corr_const"))


def _balance_sql(rate: float) -> str:
    # the copy counts for sf0.01 follow from the same driver-side arithmetic as the Spark job;
    # the oracle recomputes them in SQL from the class counts.
    return f"""WITH l AS (SELECT doc_id, quality AS label FROM labels),
c AS (SELECT count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM l),
r AS (SELECT CASE WHEN pos * 1.0 / (pos + neg) < {rate} THEN 0 ELSE 1 END AS a_label,
             CASE WHEN pos * 1.0 / (pos + neg) < {rate} THEN 1.0 - pos * 1.0 / (pos + neg) ELSE pos * 1.0 / (pos + neg) END AS r,
             CASE WHEN pos * 1.0 / (pos + neg) < {rate} THEN {1.0 - rate!r} ELSE {rate!r} END AS p,
             CASE WHEN pos * 1.0 / (pos + neg) < {rate} THEN pos ELSE neg END AS n_b FROM c),
k AS (SELECT a_label, n_b, (1.0 - p) * r / p / (1.0 - r) AS k FROM r),
kk AS (SELECT a_label, n_b, CAST(floor(k + 1e-6) AS BIGINT) AS full_copies,
              CASE WHEN k - floor(k + 1e-6) > 1e-6 THEN CAST(floor((k - floor(k + 1e-6)) * n_b + 1e-9) AS BIGINT) ELSE 0 END AS extra FROM k),
b AS (SELECT l.*, row_number() OVER (ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
      FROM l, kk WHERE l.label <> kk.a_label),
out AS (SELECT l.doc_id, l.label, 1 AS copy FROM l, kk WHERE l.label = kk.a_label
        UNION ALL SELECT b.doc_id, b.label, CAST(g.copy AS INTEGER) FROM b, kk, range(1, kk.full_copies + 1) g(copy)
        UNION ALL SELECT b.doc_id, b.label, CAST(kk.full_copies + 1 AS INTEGER) FROM b, kk WHERE b.rk <= kk.extra)
SELECT doc_id, label, copy FROM out"""


@query("balance", _balance_sql(0.5), ("T3", "first m by hash rank"))
def balance(spark, sf):
    l = table(spark, sf, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    out = SM.balance(l, "doc_id", "label", 0.5)
    return out.select("doc_id", "label", F.col("copy").cast("int").alias("copy"))


@query("positive_rate", f"""WITH bal AS ({_balance_sql(0.5)})
SELECT 'before' AS stage, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS n_pos, avg(CAST(quality AS DOUBLE)) AS pos_rate FROM labels
UNION ALL
SELECT 'after', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE label = 1) AS BIGINT), avg(CAST(label AS DOUBLE)) FROM bal""",
       ("G6", "T3"))
def positive_rate(spark, sf):
    l = table(spark, sf, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    before = ST.positive_rate(l).select(F.lit("before").alias("stage"), "*")
    after = ST.positive_rate(SM.balance(l, "doc_id", "label", 0.5)).select(F.lit("after").alias("stage"), "*")
    return before.unionByName(after).select("stage", F.col("n").cast("long"), F.col("n_pos").cast("long"), "pos_rate")


KFOLD_SQL = """SELECT doc_id, CAST(CAST(('0x' || substr(md5('123:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
FROM labels"""


@query("kfold", KFOLD_SQL, ("W2",))
def kfold(spark, sf):
    return SM.kfold(table(spark, sf, "labels", "doc_id"), "doc_id", 5, 123)


KFOLD_EXACT_SQL = """SELECT doc_id, CAST(ntile(5) OVER (ORDER BY md5('123:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS INTEGER) AS fold
FROM labels"""


@query("kfold_exact", KFOLD_EXACT_SQL, ("W2 exact", "rank by hash"))
def kfold_exact(spark, sf):
    return SM.kfold_exact(table(spark, sf, "labels", "doc_id"), "doc_id", 5, 123)


NEAR = "(0.5 + (doc_id % 7) * 1e-9)"  # ties, and scores that differ in the ninth decimal
FIXED = "((doc_id % 97 + 1) / 98.0)"
EVAL_SQL = f"""WITH s AS (SELECT doc_id, CAST(quality AS DOUBLE) AS label, {FIXED} AS score,
    CAST(CAST(('0x' || substr(md5('123:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM labels),
e AS (SELECT avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS log_loss,
             avg(CAST(CAST(score > 0.5 AS INTEGER) = label AS DOUBLE)) AS accuracy, avg(score) AS mean_score FROM s),
f AS (SELECT avg(fl) AS mean_fold_loss FROM (SELECT fold, avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS fl FROM s GROUP BY fold)),
per AS (SELECT score AS sc, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY 1),
cum AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM per),
a AS (SELECT coalesce(sum(pos * (nb + neg / 2.0)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0.0), 0.0) AS auc FROM cum),
near AS (SELECT label, {NEAR} AS sc FROM s),
per2 AS (SELECT sc, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM near GROUP BY 1),
a2 AS (SELECT coalesce(sum(p.pos * (coalesce((SELECT sum(q.neg) FROM per2 q WHERE q.sc < p.sc), 0) + p.neg / 2.0)) / nullif(CAST(sum(p.pos) * sum(p.neg) AS DOUBLE), 0.0), 0.0) AS auc_near FROM per2 p)
SELECT round(auc_near, 6) AS auc_near, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, round(mean_score, 6) AS mean_score,
       round(mean_fold_loss, 6) AS mean_fold_loss, round(auc, 6) AS auc FROM e, f, a, a2"""


@query("evaluate_scores", EVAL_SQL, ("M11", "G10", "G11", "I12"))
def evaluate_scores(spark, sf):
    l = table(spark, sf, "labels", "doc_id", "quality")
    s = SM.kfold(l.select("doc_id", F.col("quality").cast("double").alias("label"),
                          ((F.col("doc_id") % 97 + 1) / 98.0).alias("score")), "doc_id", 5, 123)
    near = s.select("label", (F.lit(0.5) + (F.col("doc_id") % 7) * 1e-9).alias("near"))
    ev = ST.evaluate(s, "label", "score", "fold").join(ST.auc(s, "label", "score"), how="cross") \
        .join(ST.auc(near, "label", "near").withColumnRenamed("auc", "auc_near"), how="cross")
    return ev.select(*[F.round(c, 6).alias(c) for c in ("auc_near", "log_loss", "accuracy", "mean_score", "mean_fold_loss", "auc")])


ENS_SQL = """SELECT doc_id, round(avg(score), 9) AS score FROM (
  SELECT doc_id, (doc_id % 97 + 1) / 98.0 AS score FROM labels
  UNION ALL SELECT doc_id, (doc_id % 89 + 1) / 90.0 FROM labels
  UNION ALL SELECT doc_id, (doc_id % 83 + 1) / 84.0 FROM labels) GROUP BY doc_id"""


@query("ensemble_mean", ENS_SQL, ("G9",))
def ensemble_mean(spark, sf):
    l = table(spark, sf, "labels", "doc_id")
    sets = [l.select("doc_id", ((F.col("doc_id") % m + 1) / (m + 1.0)).alias("score")) for m in (97, 89, 83)]
    stacked = sets[0].unionByName(sets[1]).unionByName(sets[2])
    return ST.ensemble_mean(stacked, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


MERGE_SQL = with_views(f"""SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn,
  a.word_match_share, b.len_char1, b.len_word1, (a.conv_id IS NULL OR b.conv_id IS NULL) AS row_missing
FROM (SELECT conv_id, turn, {WMS_SQL} AS word_match_share FROM tok) a
FULL OUTER JOIN (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS len_char1,
                        CAST(len({S.tokens_ws('lower(text)')}) AS BIGINT) AS len_word1
                 FROM conversations WHERE role = 'user') b ON a.conv_id = b.conv_id AND a.turn = b.turn""",
                       cp=CONV_PAIRS, tok0=TOK, tok=TOK_SW)


@query("merge_features", MERGE_SQL, ("D4", "P8"))
def merge_features(spark, sf):
    """The pair feature matrix stacked by key with a per-user-turn matrix; user turns that have
    no assistant reply have no pair row, which the missing-row flag reports."""
    t = X.tokenise(P.conv_pairs(spark, sf), ["conv_id", "turn"])
    a = t.select("conv_id", "turn", X.word_match_share())
    u = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "user")
    from ..functions import text as T
    b = u.select("conv_id", "turn", F.length("text").cast("long").alias("len_char1"),
                 F.size(T.tokens_ws(T.lower("text"))).cast("long").alias("len_word1"), "role")
    return SM.merge_cols(a, SM.sample_cols(b, ["conv_id", "turn"], ["len_char1", "len_word1"]), ["conv_id", "turn"])


SAMPLE_SQL = f"""WITH bal AS ({_balance_sql(0.5)}),
d AS (SELECT doc_id, n_chars, lang FROM documents)
SELECT bal.doc_id, bal.copy, bal.label, d.n_chars, d.lang FROM bal JOIN d ON d.doc_id = bal.doc_id"""


@query("sample_rows", SAMPLE_SQL, ("T2", "T3"))
def sample_rows(spark, sf):
    """Gather document features by the balanced index (repeats kept as ``copy``)."""
    l = table(spark, sf, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    idx = SM.balance(l, "doc_id", "label", 0.5).select("doc_id", F.col("copy").cast("int").alias("copy"), "label")
    feats = table(spark, sf, "documents", "doc_id", "n_chars", "lang")
    return SM.sample_rows(feats, idx, "doc_id").select("doc_id", "copy", "label", "n_chars", "lang")


ROWS_SQL = """SELECT row_id, v FROM (
  SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id, CAST(n_chars AS DOUBLE) AS v FROM documents
  UNION ALL
  SELECT CAST((SELECT count(*) FROM documents) + row_number() OVER (ORDER BY item_id) - 1 AS BIGINT), CAST(length(text) AS DOUBLE) FROM benchmark)"""


@query("merge_rows", ROWS_SQL, ("U1", "W4"))
def merge_rows(spark, sf):
    """Two one-column matrices stacked; W4 dense ids in order (here ordered by id first)."""
    from ..session import cut_lineage
    # dense ids read the input twice (counts, then ids): checkpoint the sorted inputs first
    d = cut_lineage(table(spark, sf, "documents", "doc_id", "n_chars").orderBy("doc_id"))
    b = cut_lineage(table(spark, sf, "benchmark", "item_id", "text").orderBy("item_id"))
    a = SM.dense_ids(d.select("doc_id", F.col("n_chars").cast("double").alias("v"))).drop("doc_id")
    c = SM.dense_ids(b.select("item_id", F.length("text").cast("double").alias("v"))).drop("item_id")
    return SM.merge_rows(a, c).select("row_id", "v")


SHAPE_SQL = with_views(f"SELECT CAST(count(*) AS BIGINT) AS n_rows, 7 AS n_cols FROM tok", cp=CONV_PAIRS, tok0=TOK, tok=TOK_SW)


@query("feature_shape", SHAPE_SQL, ("G12",))
def feature_shape(spark, sf):
    t = X.tokenise(P.conv_pairs(spark, sf), ["conv_id", "turn"])
    f = t.select("conv_id", "turn", X.word_match_share(), *X.length_columns())
    return SM.shape(f, ["conv_id", "turn"])
