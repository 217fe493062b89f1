"""Corpus pipeline: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
null text counts as empty in every stage; an empty table passes through; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drillframe.llm import packing, quality_cnn, secrets, simhash, toxicity
from drillframe.llm.common import stored, table
from drillframe.operators import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go."""
    return quality_cnn.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays."""
    return simhash.dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("toxicity", harmless), ("near-duplicates", unique), ("secrets", clean), ("packing", packed)]

#: Tokenising and the fitted stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written and read again. What a stage stored on its way, and the rows
    that it read, are deleted once its own rows are written; what the result reads stays (durable.clear deletes it)."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        start, before = durable.mark(spark), docs
        docs = stored(stage(spark, before, sf_dir))
        durable.discard_since(spark, start, docs)
        durable.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
