"""From raw documents to token files: quality, near duplicates, decontamination, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of the stage before it; ``run`` writes each stage
and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docforge.llm import jaccard, latent, mixing, quality, tokens
from docforge.llm.common import barrier
from docforge.llm.queries import VOCABULARY, tree_levels, tree_weights

#: Part of all tokens that the mixture takes; no document is taken twice.
SHARE = 0.9
SEED = 7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    return quality.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.one_of_each_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return latent.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tree of domains, languages and sources has tokens for."""
    return mixing.mix(docs, tree_levels(), tree_weights(spark), share=SHARE, epochs=1, seed=SEED).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in document order, and each document's place in them."""
    return tokens.tokenize_to_files(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Similarity groups, latent retrieval and tokenizers have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = barrier(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
