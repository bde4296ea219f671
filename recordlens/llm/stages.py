"""The stages of the pipeline: quality, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlens.llm import decontaminate, near_copies, packing, pii, quality
from recordlens.llm.common import store
from recordlens.llm.tokens import tokenizer_path

# Five words and a similarity of 0.8 or more, decided by the whole sets of every pair that operator 9 or a band value finds.
NEAR_COPIES = {"shingle": 5, "similarity": 0.8}
VOCABULARY, END_ID = "byte_bpe_50k.json", 1


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``docs``, does not reject."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id: operator 9 with an exact check, see :mod:`recordlens.llm.near_copies`."""
    return near_copies.keep_first(docs, **NEAR_COPIES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, sources in proportion."""
    return packing.pack_documents(docs, tokenizer_path(VOCABULARY), END_ID)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("mixture_packing", pack),
]

# SQL has neither a trained scorer nor fingerprints with components nor this tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each stored in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
