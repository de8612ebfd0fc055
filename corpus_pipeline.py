"""A training corpus in five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame.

Every stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``.

Null and empty texts are documents: the classifier scores them by their traits, of several one stays after exact dedup, near dedup links them with nothing,
the mix takes no words of them, so they go there. Null ids are kept apart as rows. Repeated rows are copies. Very long texts go through whole, but for the document
at each source's target. Without labels the classifier keeps all. An empty table gives an empty result. Stages read doc_id, text and source and hand on
whatever other columns there are; a stage's intermediate tables are deleted when the next stage starts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratascan.llm import common, exact_dedup, mixing, near_dedup, packing, quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    with common.owner(spark, "pipeline"):
        return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents one stays."""
    with common.owner(spark, "pipeline"):
        return exact_dedup.keep_first(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, of a similarity of 0.8 or more, one stays."""
    with common.owner(spark, "pipeline"):
        return near_dedup.keep_one(docs, near_dedup.STAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights: documents come up to three times, or not at all."""
    with common.owner(spark, "pipeline"):
        return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces with their ids."""
    with common.owner(spark, "pipeline"):
        return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("source_mix", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again; what a stage has read is deleted, the last output stays."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.lasting_path(spark, f"pipeline-{name}")
        docs = common.materialize(stage(spark, docs, sf_dir), name, path)
        if before:
            common.drop_path(spark, before)
        before = path
    common.release(spark, "pipeline")
    return docs


#: A fitted classifier and whole-set similarity can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
