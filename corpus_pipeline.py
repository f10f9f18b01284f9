"""Stages that turn raw documents into a training mix, each one an operator of ``meterloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterloom.llm import decontamination, language, mixing, repetition, simhash
from meterloom.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are too short or repeat themselves."""
    return repetition.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told or is none of the labelled ones; profiles and least scores are
    learned from the documents of this stage."""
    return language.keep_identified(docs, quantile=language.LEAST_QUANTILE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return simhash.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for, with all its columns."""
    return mixing.repeat(docs)


#: Applied in this order; each reads the Parquet table that the one before wrote.
STAGES = [
    ("quality rules", good_quality),
    ("language identification", known_language),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", no_benchmark),
    ("source mix", mixed_sources),
]

#: SQL cannot express suffix arrays, language profiles and BK-trees; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of Parquet tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
