"""A corpus pipeline of five stages over ``documents``.

quality rules -> toxicity -> near-duplicates -> suffix-array de-duplication -> packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
and hands the table that was written to the next.  The first three stages drop rows, the fourth
cuts repeated passages out of texts, the last turns documents into pieces of sequences.  Of the
documents table the columns doc_id, text, lang, source and n_chars go through, others are left out.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtrack import scratch
from gridtrack.llm import packing, quality, queries, simhash, suffix, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor their language's perplexity band rejects."""
    return quality.keep(docs.select(*COLUMNS))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; learned from the label rows op4 may learn from."""
    model = toxicity.fit(docs, queries.learned_labels(spark, sf_dir))
    return toxicity.below(docs.select(*COLUMNS), model, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the group's smallest id.

    Near: five-word shingles with a Jaccard similarity of 0.8 or more, compared exactly.  Documents
    without a word are alike and become one.
    """
    return simhash.keep_one(docs.select(*COLUMNS), width=5, least=Fraction(4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words, or of 400 bytes and more, that repeat; n_chars follows."""
    found = suffix.remove(docs, carry=("lang", "source"), words=51)
    return found.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash_near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("packing", packed_sequences),
]

# Perplexity, fingerprints and byte-pair encoding have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
