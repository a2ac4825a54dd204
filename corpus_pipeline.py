"""Corpus pipeline: language, near copies, benchmark passages, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the docs of the next one.  All but the
last return the columns of docs; a stage works on every row that its predecessor kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelquant.llm import decontaminate, language_id, mixing, ngram_join, sharding
from panelquant.llm.common import table, written
from panelquant.llm.queries import BUDGET, LANGUAGES, SHARDS, SWEEPS

#: Documents whose language is told with less certainty go; texts without letters have no language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled documents of the training fold."""
    return language_id.accepted(docs, language_id.train(docs.where(language_id.in_training(F.col("doc_id")))), LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the calibrated probabilities of their cell."""
    return mixing.sample(docs, LANGUAGES, budget=BUDGET, sweeps=SWEEPS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with slot and shard."""
    return sharding.place(docs, SHARDS, slot="slot")


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]
#: The trees of the language stage can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
