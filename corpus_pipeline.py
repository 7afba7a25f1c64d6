"""From documents to packed sequences, as a pipeline of the corpus operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last keep the columns of
documents. No stage fails on nulls or on an empty table; see the operators for what they give then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import read_table, written
from stowage.llm.exact import exact_dedup
from stowage.llm.neardup import near_dedup
from stowage.llm.packing import pack
from stowage.llm.secrets import mask_secrets
from stowage.llm.toxicity import drop_toxic, fit


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the nearest labelled examples don't call toxic, each row by its own text."""
    return drop_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies (five-word shingles, similarity 0.8), the row of the smallest id."""
    return near_dedup(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars follows the text."""
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", keep_civil),
    ("exact dedup", keep_one_of_equal),
    ("near dedup", keep_one_of_near),
    ("secret scan", hide_secrets),
    ("best-fit packing", pack_sequences),
]

#: Signatures, example search and genetic search have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
