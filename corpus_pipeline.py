"""A training corpus from raw documents: rules, copies, near copies, mixture, token ids.

Each stage takes what the one before it kept and returns the same columns; the last adds the
token ids. ``run`` writes every stage to the shared folder, so that a lost executor costs one
stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm import exact, mixing, near, pieces, quality
from paramloom.llm.tables import documents, written
from paramloom.plans.registry import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trained classifier accept."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(quality.sample_of(labels, docs, "quality"))
    return quality.keep_good(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal ones."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, 80 % alike; documents without doc_id stay."""
    dropped = near.near_duplicates(docs, percent=80).where("not kept").select(
        F.col("doc_id").alias("near_doc_id")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == F.col("near_doc_id"), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents so that tokens meet the targets per source, language and topic, some repeated."""
    return mixing.sample(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return pieces.with_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("sentencepiece ids", sentencepiece_ids),
]
#: Trained classifiers and piece paths are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
