"""The stateless pair features on a streaming pair source.

P, F, N, I and E1-E7 are column expressions, so they run on a streaming DataFrame unchanged;
TF-IDF (E8) is a stream-static join against a saved IDF table.  Sinks write to the shared
checkpoint folder with their own checkpoint location, so a restarted query resumes where it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..functions import text as T

PAIR_SCHEMA = "conv_id BIGINT, turn BIGINT, s1 STRING, s2 STRING"


def pair_stream(spark: SparkSession, source_dir: str, schema: str = PAIR_SCHEMA, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)


def stream_features(pairs: DataFrame, keys: list[str], lang: str = "spanish") -> DataFrame:
    """Stateless features per arriving pair (append-mode compatible)."""
    t = X.tokenise(pairs, keys, lang)
    return t.select(*keys, X.word_match_share(), *X.length_columns(), *X.negation_columns(),
                    *X.ngram_jaccard_columns())


def run_to_table(features: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool = True):
    """Run the stream into a parquet sink (exactly-once file sink) and wait for the available input."""
    w = (features.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q


def run_with_tfidf(pairs: DataFrame, keys: list[str], idf: DataFrame, sink_dir: str, checkpoint_dir: str,
                   lang: str = "spanish", available_now: bool = True):
    """Stateless features plus TF-IDF against a saved IDF table (stream-static).

    A pair's tokens arrive together, so each micro-batch is scored with the batch bag-of-words job
    (``foreachBatch``).  Every epoch overwrites its own folder, so a retried epoch replaces its
    earlier output instead of duplicating it.
    """
    def score(batch: DataFrame, epoch_id: int) -> None:
        t = X.tokenise(batch, keys, lang)
        base = t.select(*keys, *X.length_columns(), *X.negation_columns(), *X.ngram_jaccard_columns())
        out = base.join(X.bag_features(batch, keys, idf, lang), keys, "left")
        out.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}")

    w = pairs.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q
