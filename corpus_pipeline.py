"""A corpus pipeline: documents to token ids, in stages that each apply one corpus operator.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read back as the next stage's documents. All but the last return the
columns of documents. Labels and benchmark items come from sf_dir.

In every stage a null text counts as an empty one, repeated rows are rows like others but where a stage
says otherwise, texts of any length are taken whole, an empty table gives an empty one, and columns
besides doc_id, text and n_chars are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtable.llm import bbit_minhash, byte_bpe, cgk_decontam, entropy_secrets, toxicity_crf
from gridtable.llm.common import scratch
from gridtable.llm.queries import MULTILINGUAL, PATTERN


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go. Null and empty texts have the score of no words, and stay if
    that is less; without labels all scores are one half, and nothing stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_crf.drop_toxic(docs, toxicity_crf.train(docs, labels), least=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of least doc_id and of its repeated rows one: five words a
    shingle, similarity 0.8. Null and empty texts are near nothing and stay, as do rows without doc_id."""
    return bbit_minhash.drop_duplicates(docs, bbit_minhash.Settings(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, give or take a fifth of its words, go. Null and empty texts and items hold
    nothing and are held by nothing."""
    return cgk_decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars counted anew; all documents stay, null and empty texts as they are."""
    return entropy_secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts: doc_id, lang, source, n_tokens, ids (little-endian unsigned 32 bits each); none
    for null and empty texts."""
    return byte_bpe.encode(docs, MULTILINGUAL, PATTERN, keep=("lang", "source"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: No stage but the fixed secret patterns can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
