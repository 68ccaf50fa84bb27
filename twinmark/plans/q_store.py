"""Round trips through the text formats: data derived from the tables is written to the shared
checkpoint folder and read back with the format readers (S5-S17, D4, X3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import sampling as SM
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import pairs as P
from ..sources import smat as SMT
from ..sources import smat_source as SRC
from ..sources import textfiles as TF
from ..sources.lines import write_lines
from ..sources.store import FeatureStore, identity
from ..sources.tables import table
from .catalog import query
from .q_corpus import BASE
from .q_features import CONV_PAIRS, LEN_SQL, TOK, TOK_SW, WMS_SQL
from .views import with_views

CK = ["conv_id", "turn"]


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local path on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


LEN_COLS = ["len_char1", "len_char2", "len_word1", "len_word2", "len_char_diff", "len_word_diff"]

SMAT_SQL = with_views(f"""SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS row_id,
  {WMS_SQL} AS WordMatchShare_0,
  {", ".join(f"CAST({c} AS DOUBLE) AS Length_{i}" for i, c in enumerate(LEN_COLS))}
FROM (SELECT conv_id, turn, sw1, sw2, {LEN_SQL} FROM tok)""", cp=CONV_PAIRS, tok0=TOK, tok=TOK_SW)


@query("smat_roundtrip", SMAT_SQL, ("S7", "S8", "S10", "S11", "S12", "S15", "D4", "W4", "X3"))
def smat_roundtrip(spark, sf):
    """Pair features numbered in key order (W4), written as a dense (S12) and a sparse
    matrix, then loaded by name and stacked by row (S10, D4)."""
    t = X.tokenise(P.conv_pairs(spark, sf), CK)
    f = t.select(*CK, X.word_match_share(), *X.length_columns())
    f = SM.dense_ids(cut_lineage(f.orderBy(*CK)), "row_id")
    folder = scratch(spark, "smat")
    SMT.write_smat(SMT.dense_lines(f, "row_id", ["word_match_share"]), f"{folder}/WordMatchShare.smat", 1)
    rows = f.select("row_id")
    SMT.write_smat(SMT.sparse_lines(SMT.to_long(f, "row_id", LEN_COLS), rows), f"{folder}/Length.smat", 6)
    out = SMT.load_features(spark, folder, ["WordMatchShare", "Length"], label_name=None)
    return out.drop("row_missing")


@query("smat_source_roundtrip", SMAT_SQL, ("S7", "S8", "S10", "S11", "S12", "D4"))
def smat_source_roundtrip(spark, sf):
    """The same matrices through the data source: a dense and a sparse one written, read by stretches and stacked."""
    t = X.tokenise(P.conv_pairs(spark, sf), CK)
    f = cut_lineage(SM.dense_ids(cut_lineage(t.select(*CK, X.word_match_share(), *X.length_columns()).orderBy(*CK)), "row_id"))
    folder = scratch(spark, "smat-source")
    SRC.write_matrix(f, f"{folder}/WordMatchShare.smat", ["word_match_share"])
    SRC.write_matrix(f, f"{folder}/Length.smat", LEN_COLS, sparse=True)
    one, many = SRC.read_matrix(spark, f"{folder}/WordMatchShare.smat", "WordMatchShare"), SRC.read_matrix(spark, f"{folder}/Length.smat", "Length")
    return SM.merge_cols(one, many, ["row_id"], strict=True)


STACK_SQL = with_views(f"""SELECT conv_id, turn, {WMS_SQL} AS word_match_share, {LEN_SQL} FROM tok""", cp=CONV_PAIRS, tok0=TOK, tok=TOK_SW)
#: Buckets of the stored features.
BUCKETS = 8


@query("stacked_features", STACK_SQL, ("D4", "E10", "X3", "X4", "S17"))
def stacked_features(spark, sf):
    """E10 from a store: each group of features made once from its input, kept in buckets by pair, and stacked without a shuffle."""
    pairs = P.conv_pairs(spark, sf)
    of = identity(pairs)
    store = FeatureStore(spark, scratch(spark, "store"), CK, BUCKETS)
    t = X.tokenise(pairs, CK)
    lengths = X.length_columns()
    groups = [("WordMatchShare", [X.word_match_share()]), *[(f"Length{i // 2}", lengths[i:i + 2]) for i in range(0, len(lengths), 2)]]
    for name, columns in groups:
        store.get(name, of, lambda columns=columns: t.select(*CK, *columns))
    return store.stack([(name, of) for name, _ in groups])


VEC_SQL = f"""WITH {BASE}
SELECT word, round(list_reduce(list_transform(vec, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0), 6) AS vec_sum,
       CAST(len(vec) AS BIGINT) AS dim FROM wv"""


@query("vector_file_roundtrip", VEC_SQL, ("S6",))
def vector_file_roundtrip(spark, sf):
    """Word vectors written as ``word v1 .. vd`` text and read back (last duplicate wins)."""
    path = scratch(spark, "vectors")
    TF.write_word_vectors(P.word_vectors(spark, sf), path)
    v = TF.read_word_vectors(spark, path)
    return v.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vec_sum"),
                    F.size("vec").cast("long").alias("dim"))


@query("pairs_csv_roundtrip", with_views("SELECT s1, s2, CAST(turn AS INTEGER) AS label FROM cp", cp=CONV_PAIRS),
       ("S5", "S14", "P9"))
def pairs_csv_roundtrip(spark, sf):
    """The conversation pair table written as headered CSV (S14) and read back (S5), turn as the
    label column."""
    path = scratch(spark, "pairs")
    p = P.conv_pairs(spark, sf).select(F.col("s1").alias("spanish_sentence1"), F.col("s2").alias("spanish_sentence2"),
                                       F.col("turn").cast("string").alias("is_duplicate"))
    TF.write_pairs_csv(p, path)
    return TF.read_pair_table(spark, path, multiline=True)  # turns hold line breaks


@query("parquet_cache_roundtrip", with_views(f"SELECT conv_id, turn, {WMS_SQL} AS word_match_share FROM tok",
                                             cp=CONV_PAIRS, tok0=TOK, tok=TOK_SW), ("S17", "X4"))
def parquet_cache_roundtrip(spark, sf):
    path = scratch(spark, "cache")
    t = X.tokenise(P.conv_pairs(spark, sf), CK)
    SMT.save_cache(t.select(*CK, X.word_match_share()), path)
    return SMT.load_cache(spark, path)


@query("stream_features", with_views(f"SELECT conv_id, turn, {WMS_SQL} AS word_match_share, {LEN_SQL} FROM tok",
                                     cp=CONV_PAIRS, tok0=TOK, tok=TOK_SW), ("2.14 streaming", "E2", "E3"))
def stream_features(spark, sf):
    """Conversation pairs written as parquet files, consumed by a Structured Streaming query
    (available-now trigger, file sink with checkpoint), and read back."""
    from ..streaming import pair_stream as PS
    src, sink, ck = scratch(spark, "stream-src"), scratch(spark, "stream-sink"), scratch(spark, "stream-ckpt")
    P.conv_pairs(spark, sf).repartition(4).write.parquet(src)
    feats = PS.stream_features(PS.pair_stream(spark, src), CK)
    feats = feats.select(*CK, "word_match_share", *LEN_COLS)
    PS.run_to_table(feats, sink, ck)
    return spark.read.parquet(sink)


CLEAN = "translate(p_name, ',' || chr(9), '  ')"
FILES_SQL = f"""WITH p AS (SELECT {CLEAN} AS a, p_brand || ' ' || p_type AS b, CAST(p_partkey % 2 AS VARCHAR) AS l FROM part)
SELECT 'S1' AS layout, a AS s1, b AS s2, l AS label FROM p
UNION ALL SELECT 'S2', a, b, l FROM p
UNION ALL SELECT 'S3', a, b, l FROM p UNION ALL SELECT 'S3', a, b, l FROM p
UNION ALL SELECT 'S4', a, b, '-1' FROM p"""


@query("pair_files_roundtrip", FILES_SQL, ("S1", "S2", "S3", "S4"))
def pair_files_roundtrip(spark, sf):
    """Part names and labels written in each pair layout and read back with its reader."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").select(
        F.translate("p_name", ",\t", "  ").alias("a"), F.concat_ws(" ", "p_brand", "p_type").alias("b"),
        (F.col("p_partkey") % 2).cast("string").alias("l"))
    other = F.lit("otro")  # stands for the translations, which the readers drop
    layouts = {"csv": (",", "l", "a", "b"), "tsv": ("\t", "a", other, "b", other, "l"), "swapped": ("\t", other, "a", other, "b", "l"),
               "test": ("\t", "a", "b")}
    paths = {}
    for name, (sep, *cols) in layouts.items():
        paths[name] = scratch(spark, f"pairs-{name}")
        write_lines(p.select(F.concat_ws(sep, *cols).alias("value")), paths[name])
    read = [("S1", TF.read_pairs_csv(spark, paths["csv"])[0]), ("S2", TF.read_pairs_tsv5(spark, paths["tsv"])[0]),
            ("S3", TF.read_bilingual_pairs(spark, paths["swapped"], paths["tsv"])), ("S4", TF.read_test_pairs(spark, paths["test"]))]
    out = None
    for layout, rows in read:
        rows = rows.select(F.lit(layout).alias("layout"), "s1", "s2", F.col("label").cast("string").alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


LABELS_SQL = """SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id, CAST(toxic AS DOUBLE) AS Toxic_0,
  (doc_id % 97 + 1) / 98.0 AS Oof_0, CAST(quality AS DOUBLE) AS Label_0_0 FROM labels"""


@query("label_matrix_roundtrip", LABELS_SQL, ("S9", "S10", "S13", "S16"))
def label_matrix_roundtrip(spark, sf):
    """A label matrix merged from two row parts (S16), a feature and an out-of-fold matrix (S13), loaded
    by name and stacked with the label (S9, S10)."""
    rows = SM.dense_ids(cut_lineage(table(spark, sf, "labels", "doc_id", "quality", "toxic").orderBy("doc_id")), "row_id")
    rows = cut_lineage(rows)
    folder, half = scratch(spark, "labels"), rows.agg(F.floor(F.count(F.lit(1)) / 2)).scalar()
    first = rows.where(F.col("row_id") < half).select("row_id", "quality")
    second = rows.where(F.col("row_id") >= half).select((F.col("row_id") - half).alias("row_id"), "quality")
    for i, part in enumerate((first, second)):
        SMT.write_smat(SMT.dense_lines(part, "row_id", ["quality"]), f"{folder}/parts/{i}", 1)
    SMT.merge_parts(spark, [f"{folder}/parts/0", f"{folder}/parts/1"], f"{folder}/Label_0.smat", 1)
    SMT.write_smat(SMT.dense_lines(rows, "row_id", ["toxic"]), f"{folder}/Toxic.smat", 1)
    SMT.write_oof_feature(rows.select("doc_id", ((F.col("doc_id") % 97 + 1) / 98.0).alias("score")), f"{folder}/Oof.smat", "doc_id")
    return SMT.load_matrices(spark, folder, ["Toxic", "Oof"], "Label_0").features
