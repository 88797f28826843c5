"""A training corpus from ``documents``: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import drop, released, table, written
from quillon.llm.decontaminate import without_contaminated
from quillon.llm.near_dedup import one_of_each
from quillon.llm.packing import pack
from quillon.llm.private_data import mask_private
from quillon.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or the tokeniser's bands go."""
    return keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets."""
    return mask_private(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontaminate", decontaminate), ("private", private), ("packing", packing)]

#: A tokeniser's verdict, signatures and a learned field can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. When it returns, all tables that it wrote are deleted but for the one that holds them."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with released(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        if last is not None:
            drop(last)
        last = docs
    return docs
