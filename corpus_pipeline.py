"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Order: toxicity, near duplicates, repeated passages, source mix, packing.  All
stages but the last return the columns of documents.  No stage but the mix can
be put in SQL together with the others (a model, hashed sketches, a
tokenizer), so ``ORACLE_SQL`` is None and tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from reelspark.llm.common import staged, table

ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes or more are cut out of the texts."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document may be given up to three times."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document in a sequence of at most 4096 tokens."""
    return packing.packed_documents(docs.select("doc_id", "text"))


STAGES = [("toxicity", clean), ("near_dedup", distinct), ("suffix_dedup", unrepeated), ("mixing", mix), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"corpus-{name}")
    return docs
