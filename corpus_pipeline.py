"""Documents to training text: toxic documents go, one of each group of near duplicates stays, documents
with benchmark passages go, secrets are blotted out, and what is left is encoded.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared folder and
read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, jaccard, secrets, sentencepieces, toxicity
from vellum.session import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; those without a text stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of alike documents the one with the least doc_id stays."""
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in it gives way to a mark."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its piece ids, and whether they decode to the text again."""
    return sentencepieces.encode(docs)


STAGES = [("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", benchmark), ("secret_scans", secret), ("sentencepiece", encode)]

#: SQL has no words for the trained model, the fingerprints and the pieces: tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
