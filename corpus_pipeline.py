"""Corpus preparation: rules, classifier, near duplicates, packing, one stage after the other.

Each stage works on all documents that its predecessor kept and, but for the last, gives back the columns of
``documents``. Nulls, empty and repeated rows have the results that the operators' modules define.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleanmill.llm import jaccard, packing, quality, resample, runtime


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines that too many texts of their host share."""
    runtime.batch_limits(spark)
    return quality.clean_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """An importance sample of as many documents as the labels that are left say are good, plus two standard errors."""
    runtime.batch_limits(spark)
    return resample.sample_documents(docs, runtime.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked over shingles of five words at a similarity of 0.8 or more."""
    runtime.batch_limits(spark)
    return jaccard.one_of_each(docs, jaccard.Rule(words=5, num=80, den=100))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into windows of 2048 tokens; small memos, as other stages' workers stay alive."""
    runtime.batch_limits(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", pack),
]

#: Packing depends on the order in which documents arrive, which SQL cannot express; tests compare plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again before the next."""
    docs, before = runtime.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = runtime.cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            runtime.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
