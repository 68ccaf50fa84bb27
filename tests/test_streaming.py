"""Structured Streaming: stateless features and the stream-static TF-IDF join equal the batch job."""

import uuid

from pyspark.sql import functions as F

from twinmark.operators import features as X
from twinmark.session import ensure_checkpoint_dir
from twinmark.sources import pairs as P
from twinmark.streaming import pair_stream as PS

from .conftest import SF


def test_stream_matches_batch(spark):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-stream-{uuid.uuid4().hex}"
    pairs = P.conv_pairs(spark, SF)
    pairs.repartition(3).write.parquet(f"{base}/src")
    idf = X.corpus_idf(pairs)
    PS.run_with_tfidf(PS.pair_stream(spark, f"{base}/src"), ["conv_id", "turn"], idf, f"{base}/sink", f"{base}/ckpt")
    got = {(r.conv_id, r.turn): (r.word_match_share, round(r.tfidf_sum1 or 0.0, 9))
           for r in spark.read.parquet(f"{base}/sink").collect()}
    batch = X.bag_features(pairs, ["conv_id", "turn"], idf)
    ref = {(r.conv_id, r.turn): (r.word_match_share, round(r.tfidf_sum1, 9)) for r in batch.collect()}
    assert got == ref and len(got) == pairs.count()
