"""Feature-matrix text format (``.smat``) and feature stores.

Format: first line ``rows cols``; then one line per row of ``index:value`` tokens; row identity
is the line position.  Readers honour the indices (sparse semantics, Q14) and check the header.
Writers range-sort rows into part files whose name order is the row order, the header being the
first line of the first part.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.text import is_finite, tokens_ws
from .lines import read_lines, write_lines


def read_smat(spark: SparkSession, path, check: bool = True) -> DataFrame:
    """Long form (row_id, col, value); header ``rows cols`` validated against the body."""
    ln = read_lines(spark, path)
    header = ln.where(F.col("pos") == 0).select(tokens_ws("value").alias("h"))
    body = ln.where(F.col("pos") > 0).select((F.col("pos") - 1).alias("row_id"), "value")
    cells = (body.select("row_id", F.explode_outer(tokens_ws("value")).alias("kv")).where(F.col("kv").isNotNull())
             .select("row_id", F.split("kv", ":").alias("p"))
             .select("row_id", F.get("p", 0).cast("int").alias("col"), F.get("p", 1).cast("double").alias("value")))
    if check:
        n_rows = header.select(F.get("h", 0).cast("long")).scalar()
        n_cols = header.select(F.get("h", 1).cast("long")).scalar()
        body_rows = body.agg(F.count(F.lit(1))).scalar()
        max_col = cells.agg(F.coalesce(F.max("col"), F.lit(-1))).scalar()
        bad = F.when((body_rows != n_rows) | (max_col >= n_cols),
                     F.raise_error(F.lit("smat body does not match its header"))).otherwise(F.lit(True))
        cells = cells.where(bad)
    return cells


def smat_shape(spark: SparkSession, path) -> DataFrame:
    """Header of an .smat file as (n_rows, n_cols)."""
    h = read_lines(spark, path).where(F.col("pos") == 0).select(tokens_ws("value").alias("h"))
    return h.select(F.get("h", 0).cast("long").alias("n_rows"), F.get("h", 1).cast("long").alias("n_cols"))


def read_feature(spark: SparkSession, path, name: str, n_cols: int) -> DataFrame:
    """S8 for one matrix: wide (row_id, <name>_0 .. <name>_{n-1}); absent cells are 0."""
    cells = read_smat(spark, path)
    rows = read_lines(spark, path).where(F.col("pos") > 0).select((F.col("pos") - 1).alias("row_id"))
    wide = cells.groupBy("row_id").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"{name}_{i}")
                                          for i in range(n_cols)])
    return rows.join(wide, "row_id", "left").na.fill(0.0)


def load_features(spark: SparkSession, folder: str, names: list[str], label_name: str | None = "Label_0",
                  shapes: dict[str, int] | None = None) -> DataFrame:
    """S8 + S9 + S10 (+ D4): the named matrices of ``folder`` stacked by row, plus the label.

    A missing matrix is a clear error (Q15); matrices with different row counts raise (D4).
    """
    import os
    out = None
    for n in names + ([label_name] if label_name else []):
        p = os.path.join(folder, f"{n}.smat")
        try:
            ncols = (shapes or {}).get(n) or smat_shape(spark, p).first()["n_cols"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"feature matrix {n!r} not found under {folder}") from e
        f = read_feature(spark, p, n, int(ncols))
        if out is None:
            out = f
        else:
            from ..operators.sampling import merge_cols
            out = merge_cols(out, f, ["row_id"], strict=True)
    return out


class Matrices(NamedTuple):
    """What a load returns besides the rows: the matrices' names and widths, and the label's name."""

    features: DataFrame
    names: list[str]
    n_features: dict[str, int]
    label_name: str | None


def load_matrices(spark: SparkSession, folder: str, names: list[str], label_name: str | None = "Label_0") -> Matrices:
    """S8 + S9 + S10: ``load_features`` with the names and widths of what was loaded."""
    out = load_features(spark, folder, names, label_name)
    widths = {n: sum(c.rpartition("_")[0] == n for c in out.columns) for n in names}
    return Matrices(out, list(names), widths, label_name)


def finite(df: DataFrame, cols: list[str], reject: bool = False) -> DataFrame:
    """F4 as a step before writing: rows with a NaN or infinite value stop the job, or go if ``reject``."""
    good = F.lit(True)
    for c in cols:
        good = good & F.coalesce(is_finite(c), F.lit(True))
    if reject:
        return df.where(good)
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("a feature value is not finite")).cast("boolean")))


def cached_features(spark: SparkSession, folder: str, names: list[str], build) -> DataFrame:
    """The merged feature set of ``names``, kept under a key of that list; ``build()`` makes it once."""
    key = hashlib.sha256("\n".join(names).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/features-{key}"
    try:
        return load_cache(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return load_cache(spark, path)


def dense_lines(df: DataFrame, row_id: str, cols: list[str]) -> DataFrame:
    """S12 rows: ``0:v0 1:v1 ..`` for every feature column (dense)."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    line = F.array_join(F.transform(arr, lambda v, i: F.concat(i.cast("string"), F.lit(":"), v.cast("string"))), " ")
    return df.select(F.col(row_id).alias("row_id"), line.alias("value"))


def sparse_lines(long_cells: DataFrame, rows: DataFrame) -> DataFrame:
    """S11 rows from long (row_id, col, value): values with |v| < 1e-12 dropped, empty rows kept."""
    kept = long_cells.where(F.abs("value") >= 1e-12)
    agg = kept.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("_c"))
    line = F.coalesce(F.array_join(F.transform("_c", lambda s: F.concat(s["col"].cast("string"), F.lit(":"),
                                                                         s["value"].cast("string"))), " "), F.lit(""))
    return rows.select("row_id").join(agg, "row_id", "left").select("row_id", line.alias("value"))


def write_smat(lines: DataFrame, path: str, n_cols: int) -> None:
    """Write (row_id, value) lines with the ``rows cols`` header first."""
    n = lines.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated with the write
    header = lines.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("row_id"), F.concat(n.cast("string"), F.lit(f" {n_cols}")).alias("value"))
    write_lines(header.unionByName(lines.select(F.col("row_id").cast("long"), "value")), path, order_by="row_id")


def to_long(df: DataFrame, row_id: str, cols: list[str]) -> DataFrame:
    """Wide features to long (row_id, col, value)."""
    st = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(cols) - 1)).alias("col"),
                                F.array(*[F.col(c).cast("double") for c in cols]).alias("value")))
    return df.select(F.col(row_id).alias("row_id"), st.alias("z")).select("row_id", "z.col", "z.value")


def merge_parts(spark: SparkSession, paths: list[str], out: str, n_cols: int) -> None:
    """Row parts (each with its own header) read in the given order and written as one matrix."""
    from ..operators.sampling import merge_rows
    acc = None
    for p in paths:
        body = (read_lines(spark, p).where(F.col("pos") > 0)
                .select((F.col("pos") - 1).alias("row_id"), "value"))
        acc = body if acc is None else merge_rows(acc, body)
    write_smat(acc, out, n_cols)


def save_cache(df: DataFrame, path: str) -> None:
    """Binary feature cache as Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_oof_feature(scores: DataFrame, path: str, key: str, score: str = "score") -> None:
    """One-column matrix of out-of-fold scores, rows in key order, header ``rows 1`` (Q8)."""
    from ..operators.sampling import dense_ids
    from ..session import cut_lineage
    ordered = dense_ids(cut_lineage(scores.select(key, score).orderBy(key)), "row_id")
    write_smat(dense_lines(ordered, "row_id", [score]), path, 1)
