"""A corpus pipeline over ``documents``: toxic documents go, one of each group of near-duplicates stays,
personal data is replaced, and the rest is packed into token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlens.llm import packing, pii, simjoin, toxicity
from wardlens.llm.common import ship, stored, table
from wardlens.llm.queries import VOCABULARY


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least 0.7 go."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 of five-word shingles stays."""
    ship(spark)
    return simjoin.keep_first(docs, width=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced."""
    ship(spark)
    return pii.sanitized(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ship(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: Models and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
