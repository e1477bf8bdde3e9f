"""A training corpus from raw documents: good hosts and texts, no copies, no benchmark, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilcheck.llm.decontaminate import keep_clean
from veilcheck.llm.host_quality import keep_good
from veilcheck.llm.near_dup import keep_one
from veilcheck.llm.packing import pack_sequences
from veilcheck.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, in bins."""
    return pack_sequences(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SimHash, Hamming windows and best fit have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
