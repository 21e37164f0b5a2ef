"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, BPE. Part of the llm subpackage.

Each stage reads all that its predecessor wrote; stages meet in Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm._shared import written
from sparkloom.llm.bpe import round_trip
from sparkloom.llm.exact_dedup import drop_copies
from sparkloom.llm.mixing import mixed
from sparkloom.llm.quality_rules import keep_good
from sparkloom.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the document with the largest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest doc_id."""
    return drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their weights; documents leave as often and as far as they are drawn."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their decoding."""
    return round_trip(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("bpe", tokens)]

#: SimHash components, keyed permutations and BPE are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
