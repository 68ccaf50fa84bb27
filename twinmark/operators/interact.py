"""Token-interaction arithmetic as relational queries (M1-M8).

Input: id sequences per (pair, side) from ``corpus.to_sequences`` and the embedding table
(idx, vec) from ``corpus.embedding_table``.  The embedding table has at most ``num_words`` + 1
rows (a fixed bound), so it is broadcast; ids are shuffled, never vectors.  Interactions stay inside a pair: each pair has at
most ``maxlen`` x ``maxlen`` cells (the fixed sequence length), never pairs across the table.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance as D
from ..functions import arrow_udfs as U
from .corpus import MAX_SEQUENCE_LENGTH, pad

MATCH_TYPES = ("dot", "mul", "plus", "minus", "concat")


def token_ids(seqs: DataFrame, keys: list[str], padded: bool = False,
              maxlen: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    """(keys, side, pos, idx): the last ``maxlen`` ids of each sequence (K3's window); with
    ``padded`` the leading zero ids are kept (they read row 0, the zero vector)."""
    ids = pad("ids", maxlen) if padded else F.slice("ids", F.greatest(F.size("ids") - maxlen + 1, F.lit(1)), maxlen)
    return seqs.select(*keys, "side", F.posexplode_outer(ids).alias("pos", "idx")).where(F.col("idx").isNotNull())


def _tail(maxlen: int) -> Column:
    return F.slice("ids", F.greatest(F.size("ids") - maxlen + 1, F.lit(1)), maxlen)


def _looked_up(emb: DataFrame):
    """The embedding table, sent to the tasks in the order of its vectors."""
    t = emb.select(F.col("idx").cast("int").alias("idx"), "vec", D.norm("vec").alias("n")).orderBy("vec").toArrow().combine_chunks()
    whole = lambda c: pa.concat_arrays(t[c].chunks) if t.num_rows else t[c].combine_chunks()
    return emb.sparkSession.sparkContext.broadcast((whole("idx").to_pylist(), whole("vec"), whole("n")))


def _of_sides(rows: DataFrame, kind, of) -> Column:
    """A column made by the Arrow function ``of`` from a pair's two lists of vectors.

    On ``side_vectors`` (and what keeps its ids) the vectors are looked up where ``of`` needs them, some
    pairs at a time: only ids go to the Python workers, and only what ``of`` makes comes back.
    """
    table = rows.__dict__.get("_vectors_of_ids")
    if table is None:
        return U.sliced_udf(kind, of)("v1", "v2")
    look = U.looked_up(table)
    return U.sliced_udf(kind, lambda one, two: of(look(one)[0], look(two)[0]))("_1", "_2")


def _n_vectors(rows: DataFrame, side: int) -> Column:
    return F.col(f"n{side}") if "_vectors_of_ids" in rows.__dict__ and f"n{side}" in rows.columns else F.size(f"v{side}")


def token_vectors(seqs: DataFrame, keys: list[str], emb: DataFrame, padded: bool = False,
                  maxlen: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    """(keys, side, vecs): the vectors of a sentence's last ``maxlen`` tokens, in order; with ``padded``
    the leading zero ids are kept (they read row 0, the zero vector).  A sentence without any has no row."""
    ids = pad("ids", maxlen) if padded else _tail(maxlen)
    per = seqs.select(*keys, "side", ids.alias("ids")).repartition(*keys).groupBy(*keys, "side").agg(F.collect_list("ids").alias("_l"))
    return per.select(*keys, "side", U.vectors_udf(_looked_up(emb))("_l").alias("_v")).select(*keys, "side", F.col("_v.vec").alias("vecs")).where(F.size("vecs") > 0)


def cells(tid: DataFrame, keys: list[str]) -> DataFrame:
    """Every token of side 1 with every token of side 2 of the same pair: (keys, i, j, idx1, idx2).

    Cells carry word ids only; vectors are attached where a score is computed (``with_vectors``),
    so no cell-by-vector data is shuffled or stored.
    """
    a = tid.where(F.col("side") == 1).select(*keys, F.col("pos").alias("i"), F.col("idx").alias("idx1"))
    b = tid.where(F.col("side") == 2).select(*keys, F.col("pos").alias("j"), F.col("idx").alias("idx2"))
    return a.join(b, keys)


def with_vectors(c: DataFrame, emb: DataFrame) -> DataFrame:
    """Attach (v1, n1) and (v2, n2) to cells by broadcast lookups in the embedding table, whose
    size is bounded by ``num_words`` + 1 rows; token norms are computed once per table row."""
    e = F.broadcast(emb.select("idx", "vec", D.norm("vec").alias("_n")))
    e1 = e.select(F.col("idx").alias("idx1"), F.col("vec").alias("v1"), F.col("_n").alias("n1"))
    e2 = e.select(F.col("idx").alias("idx2"), F.col("vec").alias("v2"), F.col("_n").alias("n2"))
    return c.join(e1, "idx1").join(e2, "idx2")


def match(c: DataFrame, keys: list[str], emb: DataFrame, match_type: str = "dot", normalize: bool = False) -> DataFrame:
    """M1 (dot, optionally cosine), M2 (mul / plus / minus, element-wise), M3 (concat)."""
    if match_type not in MATCH_TYPES:
        raise ValueError(f"unknown match type {match_type!r}")
    c = with_vectors(c, emb)
    v1, v2 = F.col("v1"), F.col("v2")
    if match_type == "dot":
        score = D.dot(v1, v2)
        if normalize:  # dot of the L2-normalised vectors = dot / (|v1| |v2|); a zero vector gives 0
            score = D.try_divide(score, F.col("n1") * F.col("n2"))
        return c.select(*keys, "i", "j", score.alias("score"))
    if match_type == "concat":
        return c.select(*keys, "i", "j", F.concat(v1.cast("array<double>"), v2.cast("array<double>")).alias("vec"))
    op = {"mul": lambda x, y: x * y, "plus": lambda x, y: x + y, "minus": lambda x, y: x - y}[match_type]
    return c.select(*keys, "i", "j", F.zip_with(v1.cast("array<double>"), v2.cast("array<double>"), op).alias("vec"))


def topk(scores: DataFrame, keys: list[str], lens: DataFrame, k: int = 100,
         maxlen: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    """The k largest cells of the full maxlen x maxlen matrix, descending; padding cells
    score 0.  Per pair at most maxlen^2 values are collected."""
    per = scores.groupBy(*keys).agg(F.collect_list("score").alias("_s"))
    full = lens.join(per, keys, "left").select(
        *keys, F.concat(F.coalesce("_s", F.array().cast("array<double>")),
                        F.array_repeat(F.lit(0.0), F.lit(maxlen * maxlen) - F.col("n1") * F.col("n2"))).alias("_a"))
    return full.select(*keys, F.slice(F.sort_array("_a", asc=False), 1, k).alias("topk"))


def grid_max_pool(scores: DataFrame, keys: list[str], lens: DataFrame, p1: int = 5, p2: int = 5,
                  maxlen: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    """M5: dynamic pooling.  Grid row g reads token ``int(g / (maxlen / len))`` (an empty side reads
    nothing, i.e. 0), then the max over non-overlapping (maxlen/p1) x (maxlen/p2) blocks.

    Instead of materialising the maxlen x maxlen grid, each token maps to the blocks whose grid
    rows read it (one or two); the cells join that small map, and pairs with an empty side get
    all-zero blocks.
    """
    if maxlen % p1 or maxlen % p2:
        raise ValueError(f"a grid of {p1} x {p2} does not fit sequences of {maxlen}")
    s1, s2 = maxlen // p1, maxlen // p2
    g = F.sequence(F.lit(0), F.lit(maxlen - 1))

    def token_blocks(n, stride, tok, blk):
        m = lens.where(F.col(n) > 0).select(*keys, n, F.explode(g).alias("_g"))
        return m.select(*keys, F.floor(F.col("_g") / (F.lit(float(maxlen)) / F.col(n))).cast("int").alias(tok),
                        (F.col("_g") / stride).cast("int").alias(blk)).distinct()

    rows = token_blocks("n1", s1, "i", "bi")
    cols = token_blocks("n2", s2, "j", "bj")
    pooled = (scores.join(rows, [*keys, "i"]).join(cols, [*keys, "j"])
              .groupBy(*keys, "bi", "bj").agg(F.max("score").alias("pooled")))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(p1 * p2 - 1)))
    empty = (lens.where((F.col("n1") == 0) | (F.col("n2") == 0)).select(*keys, blocks.alias("_b"))
             .select(*keys, (F.col("_b") / p2).cast("int").alias("bi"), (F.col("_b") % p2).cast("int").alias("bj"),
                     F.lit(0.0).alias("pooled")))
    return pooled.unionByName(empty)


def soft_align(c: DataFrame, keys: list[str], emb: DataFrame) -> DataFrame:
    """M6: for each token of one side, the softmax of its dot scores over the other side's tokens
    weights that side's vectors (both directions).  Output (keys, side, pos, aligned).

    One aggregation per direction over the cells: a token has at most ``maxlen`` partners, so the
    collected list is bounded; max, exponentials and the weighted sum are array expressions on
    projected columns.
    """
    c = with_vectors(c, emb)
    outs = []
    for side, me, other in ((1, "i", "v2"), (2, "j", "v1")):
        g = (c.select(*keys, F.col(me).alias("pos"), D.dot("v1", "v2").alias("score"),
                      F.col(other).cast("array<double>").alias("v"))
             .groupBy(*keys, "pos").agg(F.collect_list(F.struct("score", "v")).alias("_l")))
        g = g.withColumn("_m", F.array_max(F.transform("_l", lambda t: t["score"])))
        g = g.withColumn("_e", F.transform("_l", lambda t: F.exp(t["score"] - F.col("_m"))))
        g = g.withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
        zero = F.array_repeat(F.lit(0.0), F.size(F.col("_l")[0]["v"]))
        wsum = F.aggregate(F.arrays_zip("_e", "_l"), zero,
                           lambda acc, t: F.zip_with(acc, t["_l"]["v"], lambda a, x: a + t["_e"] * x))
        g = g.withColumn("_w", wsum)
        outs.append(g.select(*keys, F.lit(side).alias("side"), "pos",
                             F.transform("_w", lambda x: x / F.col("_z")).alias("aligned")))
    return outs[0].unionByName(outs[1])


def side_vectors(seqs: DataFrame, keys: list[str], emb: DataFrame, maxlen: int = MAX_SEQUENCE_LENGTH, padded: bool = False) -> DataFrame:
    """One row per pair: (keys, v1, v2, k1, k2), each side's vectors in order and their norms.

    At most ``maxlen`` vectors a side, so a row is bounded; all interactions of a pair are then
    computed on its row.  Only the ids are shuffled: a row's vectors are looked up when its ids are together.
    They stay beside the vectors (``_1``, ``_2``, lists of id lists): what reads them needs no vectors from Spark.
    With ``padded`` the leading zero ids are kept (they read row 0, the zero vector).
    """
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("ids"))).alias(f"_{side}")
    last = pad("ids", maxlen) if padded else _tail(maxlen)
    ids = seqs.select(*keys, "side", last.alias("ids")).groupBy(*keys).agg(of(1), of(2))
    table = _looked_up(emb)
    look = U.vectors_udf(table)
    rows = ids.select(*keys, "_1", "_2", look("_1").alias("_v1"), look("_2").alias("_v2"))
    rows = rows.select(*keys, "_1", "_2", *[F.col(f"_v{i}.{f}").alias(f"{o}{i}") for i in (1, 2) for f, o in (("vec", "v"), ("norm", "k"))])
    rows._vectors_of_ids = table
    return rows


def score_matrix(rows: DataFrame, keys: list[str]) -> DataFrame:
    """M1 on ``side_vectors``: adds ``m``, the dot products [i][j] of the pair's tokens (and n1, n2, how many there are).

    One small matrix product per pair, in slices of an Arrow batch.  (As nested lambdas it would be put into
    the lambdas that read it, and computed anew for each cell.)
    """
    table = rows.__dict__.get("_vectors_of_ids")
    if table is None:
        return rows.withColumn("m", _of_sides(rows, U.MATRIX, U.dot_matrices))
    look = U.looked_up(table)

    def scored(one, two):
        (a, k1), (b, k2) = look(one), look(two)
        return pa.StructArray.from_arrays([U.dot_matrices(a, b), k1, k2, pc.list_value_length(a), pc.list_value_length(b)], ["m", "k1", "k2", "n1", "n2"])

    made = U.sliced_udf("m array<array<double>>, k1 array<double>, k2 array<double>, n1 int, n2 int", scored)("_1", "_2")
    out = rows.withColumn("_s", made).select(*[c for c in rows.columns if c not in ("k1", "k2")], "_s.*")
    out._vectors_of_ids = table
    return out


def matrix_topk(rows: DataFrame, keys: list[str], k: int = 100, maxlen: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    """M4 / W3 on ``score_matrix``: the k largest cells of the padded matrix, descending."""
    padded = F.concat(F.flatten("m"), F.array_repeat(F.lit(0.0), F.lit(maxlen * maxlen) - _n_vectors(rows, 1) * _n_vectors(rows, 2)))
    return rows.select(*keys, F.slice(F.sort_array(padded, asc=False), 1, k).alias("topk"))


def matrix_pool(rows: DataFrame, keys: list[str], p1: int = 5, p2: int = 5, maxlen: int = MAX_SEQUENCE_LENGTH,
                compress_ratio: int = 1) -> DataFrame:
    """M5 on ``score_matrix``: (keys, bi, bj, pooled), see ``grid_max_pool``.

    With a ``compress_ratio`` r, ``m`` is a matrix that a layer before has shrunk r times: a side of n
    tokens has n // r places in it, and the grid has maxlen / r (rounded up) rows and columns.
    """
    side = -(-maxlen // compress_ratio)
    if side % p1 or side % p2:
        raise ValueError(f"a grid of {p1} x {p2} does not fit sequences of {side}")
    s1, s2 = side // p1, side // p2

    def place(g, n):
        places = F.nullif(F.floor(_n_vectors(rows, n) / compress_ratio), F.lit(0))  # an empty side reads nothing
        return F.floor(g / (F.lit(float(side)) / places)).cast("int")

    def block(bi, bj):
        inside = lambda b, s: F.sequence(b * s, b * s + (s - 1))
        cell = lambda g: F.transform(inside(bj, s2), lambda h: F.get(F.get(F.col("m"), place(g, 1)), place(h, 2)))
        return F.array_max(F.flatten(F.transform(inside(bi, s1), cell)))

    grid = F.transform(F.sequence(F.lit(0), F.lit(p1 - 1)), lambda bi: F.transform(F.sequence(F.lit(0), F.lit(p2 - 1)), lambda bj: block(bi, bj)))
    pooled = rows.select(*keys, F.posexplode(grid).alias("bi", "_r")).select(*keys, "bi", F.posexplode("_r").alias("bj", "pooled"))
    return pooled.withColumn("pooled", F.coalesce("pooled", F.lit(0.0)))


def matrix_align(rows: DataFrame, keys: list[str]) -> DataFrame:
    """M6 on ``score_matrix``: (keys, side, pos, aligned), see ``soft_align``; two matrix products per pair.

    Where the pair's ids are in its row, its scores are made in the slice that aligns them.
    """
    if "_vectors_of_ids" in rows.__dict__:
        made = _of_sides(rows, U.ALIGNED, lambda a, b: U.alignments(U.dot_matrices(a, b), a, b))
    else:
        made = U.sliced_udf(U.ALIGNED, U.alignments)("m", "v1", "v2")
    r = rows.select(*keys, made.alias("_a"))
    sides = F.posexplode(F.array("_a.one", "_a.two")).alias("side", "_s")
    r = r.select(*keys, sides).select(*keys, (F.col("side") + 1).alias("side"), F.posexplode("_s").alias("pos", "aligned"))
    return r


def elementwise_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """M2 and M3 on ``side_vectors``: (keys, mul, plus, minus, concat), the sums over all cells of a pair; pairs with vectors on both sides."""
    found = rows.select(*keys, _of_sides(rows, U.CELL_SUMS, U.cell_sums).alias("_l"))
    return found.select(*keys, F.explode_outer("_l").alias("_c")).where(F.col("_c").isNotNull()).select(*keys, "_c.*")


def sentence_vectors(tv: DataFrame, keys: list[str]) -> DataFrame:
    """M7: element-wise mean, max and sum of each sentence's token vectors (at most ``maxlen`` of them, one row)."""
    return tv.select(*keys, "side", U.sliced_udf(U.SENTENCE, U.sentences)("vecs").alias("_s")).select(*keys, "side", "_s.mean", "_s.max", "_s.sum")


def sentence_sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    """M7 on ``side_vectors``: (keys, s1, s2), the mean, max and sum of either side, for pairs with vectors on both."""
    def both(a, b):
        ends = [pc.fill_null(pc.list_value_length(x), 0) for x in (a, b)]
        return pa.StructArray.from_arrays([U.sentences(a), U.sentences(b), pc.min_element_wise(*ends)], ["s1", "s2", "least"])

    kind = U._row(s1=U.SENTENCE, s2=U.SENTENCE, least=T.IntegerType())
    found = rows.select(*keys, _of_sides(rows, kind, both).alias("_s")).where(F.col("_s.least") > 0)
    return found.select(*keys, "_s.s1", "_s.s2")


def _pair_columns(a: str, b: str) -> list[Column]:
    return [F.zip_with(a, b, lambda x, y: F.abs(x - y)).alias("abs_diff"), F.zip_with(a, b, lambda x, y: x * y).alias("product"),
            F.concat(a, b).alias("concat")]


def pair_vectors(sv: DataFrame, keys: list[str], kind: str = "mean") -> DataFrame:
    """M8: |a - b|, a * b and concat(a, b) of the two sentence vectors of a pair.

    ``sv`` is ``sentence_vectors``, whose sides are brought together, or ``sentence_sides``, where a pair is a
    row already: nothing is shuffled, and the row's columns stay beside these.
    """
    if "side" not in sv.columns:
        return sv.select("*", *_pair_columns(f"s1.{kind}", f"s2.{kind}"))
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col(kind)))
    j = sv.groupBy(*keys).agg(*[F.get(of(i), F.lit(0)).alias(c) for i, c in ((1, "a"), (2, "b"))]).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return j.select(*keys, *_pair_columns("a", "b"))


def vec_sum(v) -> Column:
    """Left-to-right sum of an array (checksums for the oracle)."""
    return F.aggregate(F.col(v) if isinstance(v, str) else v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


# ------------------------------------------------------------------ vectors of many dimensions

def blocks(vectors: DataFrame, key: str, vec: str, size: int) -> DataFrame:
    """(key, block, values): each vector cut into stretches of ``size`` dimensions, one to a row."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(vec), F.lit(1)) - 1) / size).cast("int")), lambda b: F.struct(
        b.alias("block"), F.slice(vec, b * size + 1, F.lit(size)).cast("array<double>").alias("values")))
    return vectors.where(F.col(vec).isNotNull()).select(key, F.explode(cuts).alias("c")).select(key, "c.block", "c.values")


def blocks_from_cells(cells: DataFrame, key: str, dim: str, value: str, size: int) -> DataFrame:
    """``blocks`` from long form (key, dim, value), absent cells 0: no row ever holds a whole vector."""
    block = F.floor(F.col(dim) / size).cast("int")
    held = cells.select(key, block.alias("block"), F.struct((F.col(dim) - block * size).cast("int").alias("d"), F.col(value).cast("double").alias("x")).alias("c"))
    found = held.groupBy(key, "block").agg(F.map_from_entries(F.collect_list("c")).alias("m"))
    at = F.sequence(F.lit(0), F.lit(size - 1))
    return found.select(key, "block", F.transform(at, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("values"))


def blocked_dots(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """M1 for vectors of any dimension: (a, b, dot) for each row of ``pairs`` (a, b).

    ``left`` and ``right`` hold (key, block, values).  A pair meets its vectors block by block; the partial
    products of the blocks are summed by an aggregate, map-side first.  A vector without a row for a block is
    0 there; a pair with a vector that is not there at all has dot 0.
    """
    one = left.select(F.col(key).alias(a), "block", F.col("values").alias("_x"))
    two = right.select(F.col(key).alias(b), "block", F.col("values").alias("_y"))
    met = pairs.select(a, b).join(one, a).join(two, [b, "block"])
    product = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    summed = met.select(a, b, product.alias("_p")).groupBy(a, b).agg(F.sum("_p").alias("dot"))
    return pairs.select(a, b).join(summed, [a, b], "left").select(a, b, F.coalesce("dot", F.lit(0.0)).alias("dot"))
