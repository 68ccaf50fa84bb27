"""Corpus tables and sequence preparation.

Sentences -> content tokens (F2) -> in-vocabulary tokens (F3) -> word counts (G7) -> frequency
ranks (W1) = word index (K1) -> id sequences (K2, capped by T1) -> padded to a fixed length (K3);
the embedding table (K4) maps index -> vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow_udfs import count_words, word_ids_udf
from ..session import cut_lineage
from .sampling import dense_ids

MAX_NB_WORDS = 20000
MAX_SEQUENCE_LENGTH = 30


def rank_words(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, n, idx) with idx = 1.. by count desc, word asc.

    Counts combine map-side; the ranking is a distributed range sort whose output is
    checkpointed (fixing partition order) and numbered by per-partition offsets, so no single
    task holds the vocabulary.
    """
    return rank_counts(words.groupBy(word).agg(F.count(F.lit(1)).alias("n")), word)


def rank_counts(counts: DataFrame, word: str = "word") -> DataFrame:
    """(word, n, idx) from (word, n), see ``rank_words``."""
    ordered = cut_lineage(counts.orderBy(F.col("n").desc(), F.col(word).asc()))
    return dense_ids(ordered, "idx").withColumn("idx", F.col("idx") + 1)


def in_vocabulary(df: DataFrame, vectors: DataFrame, key_cols: list[str], tok_col: str = "toks",
                  word: str = "word") -> DataFrame:
    """keep only tokens that have a vector, order kept.

    Tokens are exploded with their position (outer, so empty lists survive as one null row),
    flagged by a left join with the vector words and re-collected; no join back to ``df``.
    """
    ex = df.select(*key_cols, F.posexplode_outer(tok_col).alias("pos", word))
    flagged = ex.join(vectors.select(word, F.lit(True).alias("_v")), word, "left")
    keep = F.when(F.col("_v").isNotNull(), F.struct("pos", word))
    agg = flagged.groupBy(*key_cols).agg(F.sort_array(F.collect_list(keep)).alias("_s"))
    return agg.select(*key_cols, F.transform("_s", lambda s: s[word]).alias(tok_col))


def sentence_sides(pairs: DataFrame, keys: list[str], lang: str = "spanish") -> DataFrame:
    """Both sides of every pair as rows (keys, side, toks) with F2 content words."""
    s = [T.with_content_words(pairs.select(*keys, F.lit(i).alias("side"), F.col(f"s{i}").alias("_s")), "_s", "toks", lang)
         .drop("_s") for i in (1, 2)]
    return s[0].unionByName(s[1])


def prepare_tokens(pairs: DataFrame, keys: list[str], vectors: DataFrame, lang: str = "spanish") -> DataFrame:
    """F2 then F3 per sentence (the reference's per-sentence normalisation)."""
    sides = sentence_sides(pairs, keys, lang)
    return in_vocabulary(sides, vectors, [*keys, "side"])


def fit_vocabulary(sides: DataFrame) -> DataFrame:
    """K1 = G7 + W1 over every token of every side (train and test): (word, n, idx)."""
    return rank_words(sides.select(F.explode_outer("toks").alias("word")).where(F.col("word").isNotNull()))


def document_tokens(docs: DataFrame, key: str, text: str, lang: str = "spanish") -> DataFrame:
    """(key, toks): the content words (F2) of each document, once however many pairs it is in."""
    d = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_s"))
    return T.with_content_words(d, "_s", "toks", lang).select(key, "toks")


def document_vocabulary(tokens: DataFrame, key: str, weights: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    """K1 over pairs of documents: (word, n, idx) for the words with a vector.

    A document counts as often as it is a side of a pair (``weights``: key, w).  Words are counted
    first, batch by batch, and only the counts meet the vector table.
    """
    texts = tokens.select(key, F.array_join("toks", " ").alias("t")).join(weights, key)  # no word holds a blank
    counts = count_words(texts.select("t", "w")).withColumnRenamed("word", word)
    known = counts.join(vectors.select(word), word)
    return rank_counts(known, word)


def document_sequences(tokens: DataFrame, key: str, vocab: DataFrame, num_words: int = MAX_NB_WORDS, last: int | None = None) -> DataFrame:
    """F3, K2 and T1 in one pass: (key, ids), order kept, unknown words and ids >= num_words dropped; with ``last`` so many at their end.

    The vocabulary holds only words with a vector, so one lookup of at most ``num_words`` rows, sent to the
    tasks, does; a document's words are looked up in its row.  A key that comes again adds its words by place:
    the last words of all its rows are among the last of each, so no more than these are shuffled.
    """
    known: dict[str, list[int]] = {}
    for r in vocab.where(F.col("idx") < num_words).select("word", F.col("idx").cast("int").alias("idx")).orderBy("idx").collect():
        known.setdefault(r.word, []).append(r.idx)
    look = word_ids_udf(tokens.sparkSession.sparkContext.broadcast(known), last)
    found = tokens.select(key, look(F.array_join("toks", " ")).alias("_s")).groupBy(key).agg(F.collect_list("_s").alias("_l"))
    merged = F.sort_array(F.flatten(F.transform("_l", lambda s: F.arrays_zip(s["at"].alias("at"), s["ids"].alias("ids")))))
    ids = F.when(F.size("_l") == 1, F.get("_l", F.lit(0))["ids"]).otherwise(F.transform(merged, lambda x: x["ids"]))
    if last is not None:
        ids = F.slice(ids, F.greatest(F.size(ids) - last + 1, F.lit(1)), last)
    return found.select(key, ids.alias("ids"))


def pair_sides(links: DataFrame, keys: list[str], values: DataFrame, key: str) -> DataFrame:
    """(keys, side, ...): both documents of every link (prev_id, pair_id) with their row of ``values``."""
    sides = links.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("prev_id").alias(key)),
                                                  F.struct(F.lit(2).alias("side"), F.col("pair_id").alias(key)))).alias("_d"))
    return sides.select(*keys, "_d.side", f"_d.{key}").join(values, key).drop(key)


def to_sequences(sides: DataFrame, keys: list[str], vocab: DataFrame, num_words: int = MAX_NB_WORDS) -> DataFrame:
    """K2 + T1: tokens -> ids, ids >= num_words and unknown tokens dropped, order kept.

    The lookup table holds at most ``num_words`` rows, so it is broadcast.
    """
    lookup = F.broadcast(vocab.where(F.col("idx") < num_words).select("word", "idx"))
    ex = sides.select(*keys, "side", F.posexplode_outer("toks").alias("pos", "word"))
    keep = F.when(F.col("idx").isNotNull(), F.struct("pos", F.col("idx").cast("int").alias("idx")))
    ids = (ex.join(lookup, "word", "left").groupBy(*keys, "side")
           .agg(F.sort_array(F.collect_list(keep)).alias("_s")))
    return ids.select(*keys, "side", F.transform("_s", lambda s: s["idx"]).alias("ids"))


def pad(ids, maxlen: int = MAX_SEQUENCE_LENGTH) -> Column:
    """K3: zeros in front, longer sequences keep their last ``maxlen`` ids."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    m = F.least(F.lit(maxlen), F.size(ids))
    tail = F.slice(ids, F.greatest(F.size(ids) - m + 1, F.lit(1)), F.greatest(m, F.lit(1)))
    return F.when(F.size(ids) == 0, F.array_repeat(F.lit(0), maxlen)).otherwise(
        F.concat(F.array_repeat(F.lit(0), maxlen - m), tail))


def embedding_table(vocab: DataFrame, vectors: DataFrame, dim: int, num_words: int = MAX_NB_WORDS) -> DataFrame:
    """K4: (idx, vec) for idx 0..min(num_words, |vocab|); row 0 and words without a vector are
    zero vectors.  Built by a left join on the (capped) vocabulary."""
    rows = vocab.where(F.col("idx") <= num_words).select("idx", "word")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    body = rows.join(vectors, "word", "left").select("idx", F.col("vec").isNotNull().alias("has_vec"),
                                                     F.coalesce("vec", zero).alias("vec"))
    row0 = vocab.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"), F.lit(False).alias("has_vec"), zero.alias("vec"))
    return row0.unionByName(body)


def coverage(vocab: DataFrame, vectors: DataFrame, emb: DataFrame) -> DataFrame:
    """Words of the index without a vector, and all-zero rows of the embedding table."""
    missing = vocab.join(vectors.select("word"), "word", "left_anti").agg(F.count(F.lit(1)).alias("words_without_vector"))
    zero_rows = emb.agg(F.count_if(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")) == 0)
                        .alias("zero_rows"))
    return missing.join(zero_rows, how="cross")
