"""The corpus pipeline: toxicity, near-dedup, benchmark decontamination, personal data, byte-level BPE.

Each stage works on all that the one before it kept, written as Parquet and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, decontaminate, near_copies, pii, shared, toxicity
from lectern.sources.tables import table

CHUNK_CHARACTERS = 4_000_000  # executors hold what earlier stages left as well


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.5 or more go. The model learns from the labels that op5 may use."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), shared.crc_remainder("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash and an exact way for the rest; five-word shingles, Jaccard similarity 0.8 or more) the document with the least id stays."""
    return near_copies.kept_one_each(docs, shared.workspace(spark, "pipeline-near-copies"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, told again or not, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), shared.workspace(spark, "pipeline-leaks"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to."""
    found = byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk_characters=CHUNK_CHARACTERS)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("byte_bpe", encode),
]

#: A trained classifier and the tokenizer have no SQL form; tests compare the pipeline with its brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared.workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = shared.settled(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
