"""The corpus queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtable.llm import bbit_minhash, byte_bpe, byte_cnn, cgk_decontam, elias_fano, entropy_secrets, pii_bootstrap, projection_dedup, rendezvous, toxicity_crf
from gridtable.llm.common import fold, scratch

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
MULTILINGUAL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_crf.score(docs, toxicity_crf.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", predicted, "n_spans", "offending")


def op2_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal weight, by doc_id; grown_shard is with a 25th."""
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = rendezvous.place(rows, "doc_id", [1.0] * 24, order=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii_bootstrap.find(table(spark, sf_dir, "documents"))
    base = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base, "spans", "n_found")


def op4_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    folder = f"{scratch(spark)}/ids"
    elias_fano.write(table(spark, sf_dir, "documents"), folder, BYTE_LEVEL, PATTERN, end=0, plain=False)
    return elias_fano.read(folder, spark).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), MULTILINGUAL, PATTERN)
    both = byte_bpe.decode(encoded, MULTILINGUAL)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return cgk_decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = byte_cnn.score(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", predicted)


def op8_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked at a cosine of 0.95."""
    return projection_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = entropy_secrets.scan(table(spark, sf_dir, "documents"))
    base = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base, "spans", "n_entropy")


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles and a similarity of 0.85, over all documents."""
    docs = table(spark, sf_dir, "documents")
    return bbit_minhash.near_duplicates(docs, bbit_minhash.Settings(shingle=3, percent=85))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_crf,
        op2_rendezvous,
        op3_pii_bootstrap,
        op4_elias_fano,
        op5_byte_bpe,
        op6_cgk_decontam,
        op7_byte_cnn,
        op8_projection_dedup,
        op9_entropy_secrets,
        op10_bbit_minhash,
    )
}
ORACLES: dict[str, str] = {}
