"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it
kept. ``docs`` has the columns of the documents table; all but the last stage
return these columns.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate, minhash, pieces, secrets, toxicity
from ledgerlight.llm.queries import tokenizer_file
from ledgerlight.llm.storage import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic (score below 0.5)."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return minhash.one_of_each(docs, minhash.Shingling(width=5, num=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; ``n_chars`` counts what is left."""
    found = secrets.scan(docs, outputs=("redacted",))
    text = F.col("redacted")
    changed = ~text.eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).withColumn("text", text).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with the byte span of each, and a digest of what they decode to."""
    coded = pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), ("n_tokens", "ids", "starts", "ends", "decoded_sha256"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "starts", "ends", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: SQL has no words for a trained model or a tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return functools.reduce(lambda d, s: work.put(s[1](spark, d, sf_dir), s[0]), STAGES, docs)
