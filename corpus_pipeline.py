"""Corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; stage results are
written as Parquet and read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import dartmin, mixing, packing, rules, toxicity
from ridgeline.llm.common import ready, stored

#: SQL cannot fit the models nor tokenize, so there is none; tests hold the stages against plain versions.
ORACLE_SQL = None

#: Share of the tokens that the mixture keeps, and the language weights it aims at.
BUDGET = 0.8
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, None: 0.05}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic (score below 0.7)."""
    ready(spark)
    labels = _labels(spark, sf_dir).where(~toxicity.held_out())
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned list."""
    ready(spark)
    return rules.passing(docs, rules.learn(*rules.sample(docs, _labels(spark, sf_dir))))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-equal texts: the one of least id."""
    ready(spark)
    return dartmin.firsts(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares are raked to the targets as far as the documents reach; no document twice.

    A value that holds less than its target of the budget gives all it has and stays below its target.
    """
    ready(spark)
    return mixing.sampled(docs, lang_weights=LANG_WEIGHTS, budget=BUDGET, max_rate=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of the kept documents."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
