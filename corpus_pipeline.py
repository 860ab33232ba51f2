"""The corpus pipeline: stages over ``documents``, each on what the one before kept.

quality classifier -> exact dedup -> near duplicates -> personal data -> packing

Every stage takes all rows its predecessor kept; ``run`` stages each result in the
shared folder, so later stages never recompute earlier ones.  Empty tables, null
texts and extra columns pass through as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm.bayes_join import drop_near_copies
from tallgrass.llm.common import documents, staged
from tallgrass.llm.exact_dedup import drop_copies
from tallgrass.llm.importance import select_quality
from tallgrass.llm.packing import pack
from tallgrass.llm.sanitise import sanitised


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest identifier."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised and disclosing terms removed."""
    return sanitised(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, MinHash and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
