"""The registered queries of this subpackage: name -> builder(spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bpe, chat, collocations, divergence, lm, packing, quality, secret_scan, sharding, simhash, suffix, toxicity
from .common import held_out, table


#: A document with this score or a higher one is toxic.
TOXIC = 0.3


def tokenizer(name: str) -> str:
    """Path of a published tokenizer file; the path is the operators' parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_learned_partitions(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_bpe(spark, sf_dir):
    path = tokenizer("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_sharding(spark, sf_dir):
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def toxicity_field(spark, docs, sf_dir):
    """Fitted on labels outside the held-out fold (crc32 of the id as text, mod 4, is 2)."""
    learnable = ~held_out(F.col("doc_id"), 4, 2)
    return toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learnable))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_field(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
                         "n_toxic_words", "spans")


def op5_chat_perspectives(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end=0)


def op7_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, lm.fit(docs, ~held_out(F.col("doc_id"), 5, 1)))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_secrets(spark, sf_dir):
    """Owners are sources; a repository is a distinct text, so a value copied all over one hot source is an example."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, F.col("source"), secret_scan.text_key(F.col("text")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example")


def op9_simhash(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark, sf_dir):
    return quality.rate(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark, sf_dir):
    """No copy stays, the first included."""
    rows = suffix.dedup(table(spark, sf_dir, "documents"), keep=None)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_learned_partitions, op2_bpe, op3_sharding, op4_toxicity, op5_chat_perspectives, op6_packing, op7_language_model, op8_secrets, op9_simhash, op10_quality_rules,
                                  op11_suffix_dedup, op12_source_divergence, op13_collocations)}
SQL: dict[str, str] = {"op5_chat_perspectives": chat.ROTATE_SQL, "op8_secrets": secret_scan.SCAN_SQL, "op10_quality_rules": quality.RATE_SQL,
                       "op12_source_divergence": divergence.AUDIT_SQL, "op13_collocations": collocations.MINE_SQL}
