"""A corpus pipeline of the text operators: documents in, token files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecflow.llm import decontamination, language, mixing, oddsketch, tokens
from vecflow.llm.common import stored, table
from vecflow.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is found; ``lang`` holds it."""
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that shares four fifths of its shingles of five words: the one with the smallest id."""
    return oddsketch.deduplicated(docs, size=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in the numbers that give each source its target; a document taken twice is two rows."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files below the shared folder, and what they hold of each document."""
    return tokens.round_trip(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents, each stored before the next reads it."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
