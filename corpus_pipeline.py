"""The corpus pipeline: stages over `documents`, each calling one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. Toxic documents go, copies go, near copies go, secrets are masked; what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from loamworks.llm.common import documents, labels, shared_dir


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labelled ones among docs, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels(spark, sf_dir)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) that with the smallest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more of five-word shingles that with the smallest id."""
    return near_dedup.drop_near_copies(docs, shingle=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths counted again."""
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), packing.Capacity(tokens=1024), end=2)


STAGES = [
    ("toxicity", clean_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: No stage but exact dedup can be said in SQL, so the rows of run() can't; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows."""
    docs = documents(spark, sf_dir)
    base = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/stage-{k}")
        docs = spark.read.parquet(f"{base}/stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
